"""Every operator over columns named like inner ones, with dots and backticks, nulls and ids of another type."""

import pytest
from pyspark.sql import functions as F

from logweir.llm import bpe, exact_dedup, hnsw, language_id, line_dedup, mixing, near, quotation, simhash, url_filter

ODD = ["meta.lang", "hash__", "version__", "code__", "rate__", "key__", "in0", "h", "sha", "set", "lo`l", "row__", "label__", "text__", "part__", "copy__", "spans", "gone", "n", "code", "key", "place"]
PASSAGE = " ".join(f"word{i}" for i in range(60))
TEXTS = [(1, f"{PASSAGE}\nown line one", "a"), (2, f"other\n{PASSAGE}", "b"), (3, "same text here", "a"), (4, "same text here", None), (5, None, "a"), (6, "", "b"), (None, "same text here", "a"), (3, "same text here", "a"), (7, "long " * 30_000, "a")]


def odd(df):
    return df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(ODD)))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string, source string").withColumn("lang", F.lit("xx"))


def ranks(tmp_path):
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def rows(df, drop=()):
    return sorted(map(repr, df.drop(*ODD, *drop).toPandas().astype(str).to_numpy().tolist()))


def quotes(df):
    return quotation.link_quotes(df.select("*", F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn")))


def vectors(df):
    embedded = df.withColumn("embedding", F.array(F.length("text").cast("double"), F.lit(1.0), F.coalesce("doc_id", F.lit(0)) * 0.01))
    return hnsw.near_duplicates(embedded, "doc_id", "embedding", "source")


OPERATORS = {
    "line_dedup": line_dedup.line_dedup,
    "mix": mixing.mix,
    "emit": lambda df: mixing.emit(mixing.mix(df)),
    "exact_dedup": exact_dedup.exact_dedup,
    "simhash": simhash.simhash_components,
    "quotes": quotes,
    "vectors": vectors,
    "urls": lambda df: url_filter.url_filter(df.withColumn("url", F.concat(F.lit("http://"), "source", F.lit(".org/"), "doc_id")), df.select(F.col("doc_id").alias("id"), F.lit(1).alias("n"), F.lit(1).alias("k")), id_col="doc_id"),
    "language": language_id.keep_known,
    "bpe": lambda df: bpe.encode_documents(df, *ranks(None)),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_columns_change_nothing(docs, name):
    plain, told = OPERATORS[name](docs), OPERATORS[name](odd(docs))
    assert rows(told) == rows(plain)
    kept = [c for c in odd(docs).columns if not (name == "simhash" and c == "text")]
    assert told.columns[: len(kept)] == kept
    for k, c in enumerate(ODD):
        got = {r[0] for r in told.select("`" + c.replace("`", "``") + "`").collect()}
        assert got <= {k}


@pytest.mark.parametrize("name", ["line_dedup", "exact_dedup", "simhash", "vectors"])
def test_text_ids(docs, name):
    text_id = F.col("doc_id").cast("string")
    source = docs if name != "vectors" else docs.withColumn("embedding", F.array(F.length("text").cast("double"), F.lit(1.0), F.lit(2.0)))
    run = OPERATORS[name] if name != "vectors" else lambda df: hnsw.near_duplicates(df, "doc_id", "embedding", "source")
    told = run(source.withColumn("doc_id", text_id))
    as_text = lambda df: df.withColumns({c: F.col(c).cast("string") for c in ("doc_id", "keep_id", "component_id") if c in df.columns})
    assert rows(as_text(told)) == rows(as_text(run(source)))


def test_near_with_odd_columns(spark, docs):
    keyed = odd(docs).withColumn("my.row", F.monotonically_increasing_id()).withColumnRenamed("my.row", "myrow")
    label = {r.myrow: r.component_id for r in near.near_components(keyed, "myrow").collect()}
    assert len(set(label.values())) == 3  # the same text, the two without words, the two with the passage
