"""Quote linking against a plain version over lists."""

import random
import re

from logweir.llm import quotation


def norm(x):
    return re.sub(r"[\s ]+", " ", x.lower()).strip(" ")


def split_up(text):
    out = []
    for line in re.split(r"\r\n|\r|\n", text):
        lead = re.match(r"[> \t]*", line).group()
        level = lead.count(">")
        line = line[len(lead) :] if level else line
        if out and out[-1][0] == level:
            out[-1][1].append(line)
        else:
            out.append((level, [line]))
    return [(a, "\n".join(b)) for a, b in out]


def slow(rows):
    said = []
    parts = []
    for c, t, x in rows:
        quoting = bool(re.search(r"(?m)^[ \t]*>", x or ""))
        p = split_up(x) if quoting else []
        body = "\n".join(b for a, b in p if a == 0).strip() if quoting else x
        parts.append((p, body))
        if c is not None and t is not None and body is not None:
            for s in {body, *(b for a, b in p if a == 0), *re.split(r"\r\n|\r|\n", body), *re.split(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*", body)}:
                said.append((norm(s), c, t))
    out = []
    up = {}
    for (c, t, x), (p, body) in zip(rows, parts):
        found = []
        n = 0
        for k, (level, text) in enumerate(p):
            if level == 0:
                continue
            n += 1
            best = None
            for rank, s in [(0, text), *((1, s) for s in text.split("\n"))]:
                s = norm(s)
                if not s or c is None or t is None:
                    continue
                own = [tt for h, cc, tt in said if h == s and cc == c]
                if own and min(own) < t:
                    best = min(filter(None, [best, (rank, 0, c, min(own))]))
                if len(s.split(" ")) >= 5:
                    every = [(cc, tt) for h, cc, tt in said if h == s]
                    if every and min(every)[0] < c:
                        best = min(filter(None, [best, (rank, 1, *min(every))]))
            if best:
                found.append((level, k, best))
        to = min(found)[2][2:] if found else (None, None)
        if found and to[0] < c:
            up[c] = min(up.get(c, to[0]), to[0])
        out.append([c, t, x, *to, n, len(found), max([a for a, _ in p], default=0), body])
    for r in out:
        root = r[0]
        while root in up:
            root = up[root]
        r.append(root)
    return out


def key(r):
    return repr(r)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(25)]
    rows = []
    for c in range(12):
        for t in range(rng.randint(1, 7)):
            lines = [" ".join(rng.choice(words) for _ in range(rng.choice((1, 3, 6, 8)))) for _ in range(rng.randint(1, 4))]
            if rows and rng.random() < 0.7:
                src = rng.choice([r for r in rows if r[0] == c] or rows) if rng.random() < 0.6 else rng.choice(rows)
                quoted = (src[2] or "").split("\n")
                if rng.random() < 0.4:
                    quoted = quoted[: rng.randint(1, len(quoted))]
                lines = ["> " + x.upper() if rng.random() < 0.5 else ">" + x for x in quoted] + lines + (["", "tail"] if rng.random() < 0.3 else [])
            rows.append((c, t, "\n".join(lines)))
    return rows + [(3, 0, rows[0][2]), (50, 0, None), (50, 1, ""), (50, 2, "> "), (None, 1, "> word1 word2"), (51, None, "hello there my dear friends"), (52, 1, ">>> deep\r\n> hello there my dear friends\r\nyes")]


def test_against_plain_version(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        frame = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], "conv_id long, turn long, text string, body string, mid string, part string, root string")
        got = quotation.link_quotes(frame).collect()
        mine = sorted(([r.conv_id, r.turn, r.text, r.reply_conv, r.reply_turn, r.n_quotes, r.n_linked, r.deepest, r.body, r.thread_id] for r in got), key=key)
        want = sorted(slow(rows), key=key)
        assert mine == want
        assert sum(r.n_linked for r in got) > 10
        threads = {}
        for r in got:
            threads.setdefault(r.thread_id, []).append(r)
        for own in threads.values():
            own.sort(key=lambda r: r.position)
            assert [r.position for r in own] == list(range(len(own)))
            places = [(-1 if r.conv_id is None else r.conv_id, -1 if r.turn is None else r.turn) for r in own]
            assert places == sorted(places)


def test_no_quotes_and_empty(spark):
    frame = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "a > b"), (2, 0, "user", None)], "conv_id long, turn long, role string, text string")
    got = quotation.link_quotes(frame).collect()
    assert sorted((r.conv_id, r.position, r.body) for r in got) == [(1, 0, "hi"), (1, 1, "a > b"), (2, 0, None)]
    assert quotation.link_quotes(frame.where("false")).count() == 0


def test_blanks_take_linear_time(spark):
    import time

    rows = [(1, 1, "a" + " " * 1_000_000 + "b\n> quoted words of another one here\n" + " " * 1_000_000 + "x"), (1, 2, "> a\n" + " \t" * 500_000 + "\nend")]
    began = time.time()
    got = quotation.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    assert len(got) == 2 and time.time() - began < 60
