"""Language identification by fusing evidence.

The text's likelihood comes from byte trigrams of its letters, hashed into a fixed
number of buckets, under one model per language; trigrams overlap, so their sum
is tempered to the weight of ``EVIDENCE`` of them. A uniform model stands for text
in no known language. A first posterior from the text alone is summed
by host, registered domain, declared language and address suffix. Those sums give
the priors of a host, smoothed towards its domain and all pages, and the likelihoods of
what is declared and of the suffix; each row's own share is taken out of the sums
first. The answer is the posterior of all four.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .scratch import Scratch, Sealed, quoted
from .url_filter import domain_of, host_of, suffix_of

BUCKETS = 1 << 15
EVIDENCE = 200
SAMPLE_ROWS = 4000
LEAST_ROWS = 10
STRENGTH = 20.0
UNKNOWN = "und"
ACCEPT = 0.5
OWN = ("language", "posterior", "accepted")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_CODE = re.compile(r"(?i)<(script|style)\b")
_CODE_END = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style")}
_ENTITY = re.compile(r"&[#\w]+;")


def trigrams(text: str) -> np.ndarray:
    """The bucket of each trigram of UTF-8 bytes of the lower-cased letters; nothing if there are none."""
    letters = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not letters:
        return np.zeros(0, np.int64)
    b = np.frombuffer(f" {letters} ".encode(), np.uint8).astype(np.uint32)
    code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(17)


def plain(text: str, markup: bool) -> str:
    """The text without markup: scripts, styles, comments, tags and entities are a blank each. What isn't closed is looked for once, so a broken page takes linear time."""
    if not markup:
        return text
    out, at, open_ = [], 0, set()
    while (start := text.find("<", at)) >= 0:
        end, code = -1, _CODE.match(text, start)
        if code and (name := code[1].lower()) not in open_:
            closed = _CODE_END[name].search(text, code.end())
            end = closed.end() if closed else -1
            if end < 0:
                open_.add(name)
        elif text.startswith("<!--", start) and "!" not in open_:
            end = text.find("-->", start + 4) + 3
            if end < 3:
                open_.add("!")
                end = -1
        if end < 0:
            end = text.find(">", start) + 1
            if not end:
                break
        out += [text[at:start], " "]
        at = end
    return _ENTITY.sub(" ", "".join(out) + text[at:])


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", rows: int = SAMPLE_ROWS, id_col: str = "doc_id", least: int = LEAST_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities of each bucket, fitted on the ``rows`` labelled documents of each language with the least hashes of their id and text.

    Every language with ``least`` labelled rows in the whole table is learnt, however
    large the table. A bound on the hash, from the language's number of rows, leaves little
    more than the sample to be sorted, so no task gets more of the texts than that.
    """
    sealed = Sealed(docs)
    lang, text = F.col(sealed[lang_col]), F.col(sealed[text_col])
    labelled = sealed.rows.where(lang.isNotNull() & (F.length(text) > 0)).select(lang.alias("lang"), text.alias("text"), F.xxhash64(sealed[id_col], text).alias("h"))
    sizes = labelled.groupBy("lang").count().where(F.col("count") >= least).collect()  # one row a language
    bounds = [(r.lang, min(2**63 - 1, int(-(2**63) + min(1.0, 1.2 * rows / r["count"]) * (2**64 - 1)))) for r in sizes]
    bounds = docs.sparkSession.createDataFrame(bounds, "lang string, bound long")
    near = labelled.join(F.broadcast(bounds), "lang").where(F.col("h") <= F.col("bound"))
    sample = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("place") <= rows).select("lang", "text")

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BUCKETS, np.int64)
        for text in frame["text"]:
            total += np.bincount(trigrams(text), minlength=BUCKETS)
        return pd.DataFrame([[frame["lang"].iloc[0], len(frame), total.tobytes()]], columns=["lang", "n", "counts"])

    found = sample.groupBy("lang").applyInPandas(count, "lang string, n long, counts binary").where(F.col("n") >= least).collect()
    found.sort(key=lambda r: r.lang)
    counts = np.array([np.frombuffer(r.counts, np.int64) for r in found], float).reshape(len(found), BUCKETS)
    return [r.lang for r in found], np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))


def _likelihoods(held, markup: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            at = batch.schema.get_field_index("text__")
            scores = []
            for text in batch.column(at):
                grams = trigrams(plain(text.as_py() or "", markup))
                n = len(grams)
                scores.append([n, *(table[grams].sum(axis=0) * (min(1.0, EVIDENCE / n) if n else 0.0))])
            scores = np.array(scores, float).reshape(batch.num_rows, 1 + table.shape[1])
            scores = np.hstack([scores, _softmax(scores[:, 1:])])
            out = [c for i, c in enumerate(batch.columns) if i != at] + [pa.array(scores[:, k]) for k in range(scores.shape[1])]
            names = [n for n in batch.schema.names if n != "text__"] + ["grams__"] + [f"{c}{k}__" for c in ("ll", "p") for k in range(table.shape[1])]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def _softmax(logs: np.ndarray) -> np.ndarray:
    parts = np.exp(logs - logs.max(axis=1, keepdims=True)) if len(logs) else logs
    return parts / parts.sum(axis=1, keepdims=True)


def _fused(names: list[str], id_cols: list[str], totals: np.ndarray, n_all: float, kinds: tuple[int, int], accept: float):
    """Rows with their own likelihoods and the sums of their host, domain, declaration and suffix to the answer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = len(names)
        for frame in batches:
            table = lambda tag, end="": frame[[f"{tag}{k}{end}" for k in range(size)]].to_numpy(float)  # noqa: E731, B023
            count = lambda c: frame[c].to_numpy(float)[:, None]  # noqa: E731, B023
            own = table("p", "__")
            rest = totals - own
            everywhere = (rest + 1) / (n_all - 1 + size)
            in_domain = (table("d") - own + STRENGTH * everywhere) / (count("dn") - 1 + STRENGTH)
            prior = (table("h") - own + STRENGTH * in_domain) / (count("hn") - 1 + STRENGTH)
            said = (table("c") - own + 1) / (rest + kinds[0])
            suffix = (table("s") - own + 1) / (rest + kinds[1])
            post = _softmax(table("ll", "__") + sum(np.log(np.maximum(x, 1e-12)) for x in (prior, said, suffix)))
            best = post.argmax(axis=1)
            answer = np.where(frame["grams__"].to_numpy() > 0, np.array(names, object)[best], UNKNOWN) if len(frame) else []
            out = frame[[*id_cols, "host", "suffix", "declared"]].assign(language=answer, posterior=post.max(axis=1) if len(frame) else [])
            out["accepted"] = (out["language"] != UNKNOWN) & (out["posterior"] >= accept)
            yield out

    return run


def identify(
    rows: DataFrame, model: tuple[list[str], np.ndarray], id_cols: list[str], text_col: str, url: Column | None = None, host: Column | None = None,
    declared: Column | None = None, markup: bool = False, accept: float = ACCEPT,
) -> DataFrame:
    """id_cols, host, suffix, declared, language, posterior and accepted, of every row.

    A row is accepted if a known language has a posterior of at least ``accept``. A null or
    empty text, or one without letters, has no language and isn't accepted. A missing url, host or
    declaration is a value of its own, so it weighs as little as it tells. Repeated
    rows get the same answer, and all rows of a table without labelled text are unknown.
    """
    scratch = Scratch(rows.sparkSession, "language")
    names, logs = model
    names = [*names, UNKNOWN]
    table = np.vstack([logs, np.full((1, BUCKETS), -np.log(BUCKETS))]).T.copy()
    held = rows.sparkSession.sparkContext.broadcast(table)  # BUCKETS numbers a language
    host = host if host is not None else host_of(url) if url is not None else F.lit("")
    declared = F.lower(F.trim(declared)) if declared is not None else F.lit("")
    ids = [f"id{i}" for i in range(len(id_cols))]
    facts = rows.select(
        *(F.col(quoted(c)).alias(i) for c, i in zip(id_cols, ids)), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(suffix_of(host_of(url)) if url is not None else F.lit(""), F.lit("")).alias("suffix"),
        F.coalesce(declared, F.lit("")).alias("declared"), F.col(quoted(text_col)).alias("text__"),
    )
    ll, share = [f"ll{k}__" for k in range(len(names))], [f"p{k}__" for k in range(len(names))]
    given = T.StructType([f for f in facts.schema if f.name != "text__"])
    schema = T.StructType([*given, *(T.StructField(c, T.DoubleType()) for c in ["grams__", *ll, *share])])
    scored = scratch.keep(facts.mapInArrow(_likelihoods(held, markup), schema), texts=True)
    first = scored.withColumn("domain__", domain_of(F.col("host")))

    def summed(keys: list[str], tag: str) -> DataFrame:
        return scratch.keep(first.groupBy(*keys).agg(*[F.sum(c).alias(f"{tag}{k}") for k, c in enumerate(share)], F.count("*").alias(f"{tag}n")), small=True)

    hosts = summed(["host", "domain__"], "h")
    domains = scratch.keep(hosts.groupBy("domain__").agg(*[F.sum(f"h{k}").alias(f"d{k}") for k in range(len(names))], F.sum("hn").alias("dn")), small=True)
    by_declared, by_suffix = summed(["declared"], "c"), summed(["suffix"], "s")
    whole = by_suffix.agg(*[F.sum(f"s{k}") for k in range(len(names))], F.sum("sn"), F.count("*")).first()
    n_all, n_suffix, n_declared = float(whole[len(names)] or 0), whole[len(names) + 1], by_declared.count()
    placed = scratch.keep(hosts.join(domains, "domain__").drop("domain__"), small=True)
    joined = first.drop("domain__").join(placed, "host").join(by_declared, "declared").join(by_suffix, "suffix")
    totals = np.array([float(whole[k] or 0) for k in range(len(names))])
    schema = T.StructType([*given, T.StructField("language", T.StringType()), T.StructField("posterior", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    told = joined.mapInPandas(_fused(names, ids, totals, n_all, (n_declared, n_suffix), accept), schema)
    return told.select(*(F.col(i).alias(c) for c, i in zip(id_cols, ids)), "host", "suffix", "declared", "language", "posterior", "accepted")


def declared_in(html: Column) -> Column:
    """The primary subtag of the html element's lang attribute; empty if there is none."""
    return F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)


def keep_known(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", least: int = LEAST_ROWS) -> DataFrame:
    """The documents in a known language: lang_col is what they declare, source_col their host. All columns stay as they are.

    A language is known if ``least`` rows of the table declare it. A text with letters that declares a rarer one stays
    unjudged: nothing is known against it. Rows of one text, lang and source are judged alike.
    """
    scratch, sealed = Scratch(docs.sparkSession, "known"), Sealed(docs)
    model = train(docs, lang_col, text_col, id_col=id_col, least=least)
    text, lang, source = (F.col(sealed[c]) for c in (text_col, lang_col, source_col))
    told_apart = [x for c in (text, lang, source) for x in (c, c.isNull())]  # hashes skip nulls
    keyed = sealed.rows.withColumns({"a": F.xxhash64(*told_apart), "b": F.xxhash64(F.lit(1), *told_apart)})
    rare = F.coalesce(lang.isNotNull() & ~lang.isin(model[0]) & text.rlike(r"\p{L}"), F.lit(False))
    told = identify(keyed.where(~rare).select("a", "b", text.alias("text"), lang.alias("lang"), source.alias("source")), model, ["a", "b"], "text", host=F.col("source"), declared=F.col("lang"))
    gone = scratch.keep(told.where("not accepted").select("a", "b").distinct(), small=True)
    return keyed.join(gone, ["a", "b"], "left_anti").select(*sealed.restored())
