"""The registered queries of the log engine, over the shared test tables. Each name is also a key of oracles.ORACLES where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions import level as lv, numeric as nm, show as sh, signature as sg, text as tx, time as tm, transforms as tr, units as un
from .operators import analyze, anomaly, detect, pages, similar, staging, templates
from .plans import batch, semantic
from .plans.provider import TextModel
from .schema import FIELD_MAPPINGS, FORMATS, REGISTRY
from .sources import generator, raw_records, readers, sinks, splits
from .sources.catalogue import Catalogue
from .streaming.ingest import windowed_counts
from .tables import cut, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
FILES, FILE_EVENTS = 10, 50_000


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows in as many partitions as there are cores, where a small file makes fewer: what follows costs more than moving them."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as what a log line says: iso, level, message, user, cents."""
    e = table(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").when(F.col("event_type") == "purchase", "NOTICE").otherwise("INFO")
    return spread(e).select(
        "event_id", "ts", "event_type", "props", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"), level.alias("level"), F.format_string("user %s did %s", F.col("user_id").cast("string"), "event_type").alias("message"),
        F.col("user_id").alias("user"), F.floor(F.col("value") * 100).cast("long").alias("cents"),
    )


def _line(fmt: str) -> Column:
    """One event in one format."""
    user, cents = F.col("user").cast("string"), F.col("cents").cast("string")
    row = lambda by: F.concat_ws(by, "iso", "level", user, cents, "message")
    return {
        "plain_text": F.format_string("%s [%s] %s", "iso", "level", "message"), "key_value": F.format_string('ts: %s level=%s user=%s cents=%s msg="%s"', "iso", "level", user, cents, "message"),
        "logfmt": F.format_string("ts=%s level=%s user=%s cents=%s msg='%s'", "iso", "level", user, cents, "message"), "delimiter": row("|"), "csv": row(","), "tsv": row("\t"),
        "json": F.format_string('{"time":"%s","severity":"%s","ctx":{"user":%s,"cents":"%s"},"msg":"%s"}', "iso", F.lower("level"), user, cents, "message"),
        "xml": F.format_string('<entry id="%s"><ts>%s</ts><level>%s</level><cents>%s</cents><message>%s</message></entry>', user, "iso", "level", cents, "message"),
        "yaml": F.format_string("---\nts: %s\nlevel: %s\nctx:\n  user: %s\n  cents: %s\nmessage: '%s'", "iso", "level", user, cents, "message"),
        "syslog": F.format_string("<%s>1 %s host%s app %s ID%s - %s", F.when(F.col("level") == "ERROR", "11").when(F.col("level") == "WARN", "12").when(F.col("level") == "NOTICE", "13").otherwise("14"), "iso", user, cents, F.col("event_id").cast("string"), "message"),
        "binary": F.format_string("%s %s %s\x01", "level", user, cents),
    }[fmt]


def files(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    """Events in FILES files of a format, more where a file had over FILE_EVENTS, in order; the tables have a header."""
    e = facts(spark, sf_dir)
    n = max(FILES, table(spark, sf_dir, "events").count() // FILE_EVENTS)
    lines = e.select((F.col("event_id") % n).alias("file"), F.struct("event_id", _line(fmt).alias("line")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "" if fmt == "binary" else "\n")
    head = {"csv": "timestamp,level,user,cents,message\n", "tsv": "timestamp\tlevel\tuser\tcents\tmessage\n", "delimiter": "timestamp|level|user|cents|message\n"}.get(fmt, "")
    text = F.concat(F.lit("<log>"), body, F.lit("</log>")) if fmt == "xml" else F.concat(F.lit(head), body)
    return lines.groupBy("file").agg(text.alias("text")).repartition(n).select(F.concat(F.lit("f"), F.col("file").cast("string")).alias("source"), F.encode("text", "UTF-8").alias("content"))


def _parsed(fmt: str, user: str, cents: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        records = readers.ingest(files(spark, sf_dir, fmt), fmt, reference_year=2024)
        field = lambda k: F.try_element_at("fields", F.lit(k)) if k else F.lit(None).cast("string")
        return records.select("source", "line_number", "record_id", "timestamp", "level", "message", field(user).alias("user"), field(cents).alias("cents"), "corrupted")

    return run


for _fmt, _user, _cents in (
    ("plain_text", "", ""), ("key_value", "user", "cents"), ("logfmt", "user", "cents"), ("delimiter", "user", "cents"), ("csv", "user", "cents"), ("tsv", "user", "cents"), ("json", "ctx.user", "ctx.cents"),
    ("xml", "@id", "cents"), ("yaml", "ctx.user", "ctx.cents"), ("syslog", "hostname", "pid"),
):
    QUERIES[f"parse_{_fmt}"] = _parsed(_fmt, _user, _cents)


@query
def parse_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = readers.ingest(files(spark, sf_dir, "binary"), "binary")
    return records.select("source", "line_number", "record_id", F.try_element_at("fields", F.lit("hex")).alias("hex"), F.try_element_at("fields", F.lit("offset")).alias("at"))


@query
def csv_in_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as real CSV files, with line breaks, commas and quotes in cells, read back in splits."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    message = F.format_string('user %s did "%s",\nthen left', F.col("user").cast("string"), "event_type")
    facts(spark, sf_dir).select(F.col("iso").alias("timestamp"), "level", F.col("event_id").alias("number"), "cents", message.alias("message")).write.option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)
    records = splits.ingest_csv(spark, path, "*.csv")
    field = lambda k: F.try_element_at("fields", F.lit(k))
    return records.select(field("number").alias("number"), "timestamp", "level", "message", field("cents").alias("cents"), "corrupted", (F.col("line_number") > 1).alias("below_head"))


@query
def registry_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after a batch of the errors and sign-ups, one of all events, and the second once more."""
    store = batch.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    raw = _vendor(spark, sf_dir).withColumn("x", F.try_element_at("record", F.lit("raw_text")))
    few = raw.where(F.col("x").rlike("did (error|signup)$"))
    for number, rows in ((0, few), (1, raw), (1, raw)):
        if not sinks.is_done(spark, store.at("registry"), ("queries", number)):
            _, signed, made = semantic.map_records(rows.drop("x"), store.table("registry", REGISTRY), Actions())
            signed = cut(signed)
            store.update("registry", REGISTRY, signed, lambda stored: semantic.learn(stored, signed, made, "now"), ("queries", number))  # noqa: B023
    return store.table("registry", REGISTRY).select("signature", "format_type", F.size("regex_patterns").alias("n_patterns"), "hit_count")


@query
def detect_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = [files(spark, sf_dir, f).select(F.lit(f).alias("rendered"), detect.detect_format(F.col("content"), F.lit("x")).alias("detected")) for f in FORMATS]
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every.groupBy("rendered", "detected").agg(F.count("*").alias("n"))


@query
def route_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = facts(spark, sf_dir)
    form = F.when(F.col("event_id") % 5 == 0, _line("json")).when(F.col("event_id") % 5 == 1, _line("logfmt")).when(F.col("event_id") % 5 == 2, _line("syslog")).when(F.col("event_id") % 5 == 3, F.col("message")).otherwise(_line("xml"))
    return e.select((F.col("event_id") % 5).alias("kind"), detect.route_text(form).alias("route")).groupBy("kind", "route").agg(F.count("*").alias("n"))


@query
def stream_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor records of single lines, all kinds."""
    e = facts(spark, sf_dir)
    form = F.when(F.col("event_id") % 4 == 0, F.format_string('{"a":{"b":[%s,2]},"m":"%s"}', F.col("user").cast("string"), "message")).when(F.col("event_id") % 4 == 1, _line("logfmt")).when(F.col("event_id") % 4 == 2, _line("syslog")).otherwise(F.format_string("%s|%s", F.col("user").cast("string"), "message"))
    parsed = raw_records.parse_texts(e.select(F.col("event_id").alias("id"), form.alias("text")))
    got = lambda *ks: F.coalesce(*[F.try_element_at("record", F.lit(k)) for k in ks])
    return parsed.select("id", "format", got("a.b[0]", "user", "hostname", "field_0").alias("who"), got("m", "msg", "message", "field_1").alias("what"), got("severity", "level").alias("level"))


@query
def vendor_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor records of texts whose format is told."""
    e = facts(spark, sf_dir)
    user, kinds = F.col("user").cast("string"), ("xml", "csv", "tsv", "yaml", "keyvalue", "plaintext")
    forms = (
        F.format_string("<logs><log><user>%s</user><msg>%s</msg></log></logs>", user, "message"), F.format_string("user,msg\n%s,%s", user, "message"), F.format_string("user\tmsg\n%s\t%s", user, "message"),
        F.format_string("user: %s\nmsg: %s", user, "message"), F.format_string('user=%s msg: "%s"', user, "message"), F.col("message"),
    )
    pick = lambda xs: F.get(F.array(*xs), (F.col("event_id") % len(kinds)).cast("int"))
    parsed = raw_records.parse_texts(e.select(F.col("event_id").alias("id"), pick(map(F.lit, kinds)).alias("kind"), pick(forms).alias("text")), "kind")
    got = lambda *ks: F.coalesce(*[F.try_element_at("record", F.lit(k)) for k in ks])
    return parsed.select("id", "format", got("user", "log.user").alias("who"), got("msg", "log.msg", "raw_text").alias("what"))


@query
def fn_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = facts(spark, sf_dir)
    shapes = ["yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "dd/MMM/yyyy:HH:mm:ss '+0130'", "MMM d yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "dd-MM-yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy", "'no time at' HH"]
    kind = F.col("event_id") % len(shapes)
    text = F.lit(None).cast("string")
    for i, s in enumerate(shapes):
        text = F.when(kind == i, F.date_format("ts", s)).otherwise(text)
    return e.select("event_id", text.alias("given")).select("event_id", "given", tm.to_iso8601(tm.parse_timestamp(F.col("given"))).alias("iso"), tm.extract_timestamp(F.concat(F.lit("at "), "given", F.lit(" done"))).alias("token"), tm.standardise_timestamp(F.col("given"))[0].alias("standard"))


@query
def fn_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = facts(spark, sf_dir)
    cents = F.col("cents").cast("string")
    kind = F.col("event_id") % 7
    text = F.when(kind == 0, F.concat(cents, F.lit("ms"))).when(kind == 1, F.concat(cents, F.lit(" kPa"))).when(kind == 2, F.concat(F.lit(" -"), cents)).when(kind == 3, F.concat(cents, F.lit("%"))).when(kind == 4, F.concat(F.lit("1,"), F.lpad(cents, 6, "0"))).when(kind == 5, F.concat(F.lit("id-"), cents)).otherwise(F.concat(cents, F.lit("5d")))
    return e.select("event_id", nm.coerce_value(text).alias("coerced"), nm.remove_units(text).alias("bare"))


@query
def fn_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = facts(spark, sf_dir)
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("a warning: "), "message")).when(F.col("event_id") % 3 == 1, F.concat("message", F.lit(" [Fatal]"))).otherwise(F.col("message"))
    return e.select("event_id", lv.extract_level(text).alias("level"), lv.syslog_level(F.col("event_id")).alias("by_priority"))


@query
def fn_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = facts(spark, sf_dir)
    text = F.concat(F.lit("\x1b[31m  "), "message", F.lit("\t\t \x07"), "level", F.lit("\x1b[0m "))
    return e.select("event_id", tx.clean_text(text).alias("clean"), tx.normalize_delimiter(F.concat_ws("|;", "level", "message")).alias("commas"), F.array_join(tx.special_characters(F.col("iso")), "").alias("marks"))


@query
def fn_key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = facts(spark, sf_dir)
    pairs = tx.parse_kv_pairs(F.format_string("user=%s msg: \"%s\" level='%s' user=last.%s", F.col("user").cast("string"), "message", "level", F.col("cents").cast("string")))
    return e.select("event_id", pairs["user"].alias("user"), pairs["msg"].alias("msg"), pairs["level"].alias("level"), F.size(pairs).alias("n"), sg.schema_fingerprint(pairs).alias("fingerprint"))


@query
def fn_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = facts(spark, sf_dir)
    line = F.format_string("%s %s host=10.0.0.%s id=0x%s took %s.5 /var/log/%s.log %s", "iso", "message", (F.col("event_id") % 250).cast("string"), F.lower(F.hex("event_id")), F.col("cents").cast("string"), "event_type", (F.lit(1600000000) + F.col("event_id")).cast("string"))
    return e.select("event_id", sg.mask_variables(line).alias("masked"), sg.generate_signature(line).alias("signature"))


@query
def signature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).groupBy(sg.generate_signature(F.col("message")).alias("signature")).agg(F.count("*").alias("n"))


@query
def fn_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = facts(spark, sf_dir)
    kind, n = F.col("event_id") % 6, F.concat((F.col("cents") % 2000).cast("string"), F.lit(".21"))
    unit = lambda *u: F.get(F.array(*map(F.lit, u)), (F.col("event_id") / 6 % len(u)).cast("int"))
    fields = {"temperature": ("C", "F", "k", ""), "pressure": ("Pa", "mTorr", "PSI", "bar"), "rf_power": ("W", "kW"), "flow_rate": ("sccm", "slm", "x"), "voltage": ("V", "kV"), "current": ("mA", "uA")}
    values, flags = un.normalise_units({f: F.when(kind == i, F.concat(n, unit(*u))) for i, (f, u) in enumerate(fields.items())})
    return e.select("event_id", *[F.round(v, 6).alias(f) for f, v in values.items()], F.array_join(flags, ",").alias("flags"))


@query
def fn_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = facts(spark, sf_dir)
    n = F.col("cents").cast("string")
    name = lambda t, c: tr.apply_transform(t, c)
    return e.select(
        "event_id", F.round(name("fahrenheit_to_celsius", n), 6).alias("celsius"), F.round(name("torr_to_pa", n), 3).alias("pa"), name("mw_to_w", n).alias("w"), name("normalize_unit_id", F.concat(F.lit("Unit "), (F.col("event_id") % 120).cast("string"))).alias("unit"),
        name("normalize_alarm_severity", F.when(F.col("level") == "WARN", "Warning ").when(F.col("level") == "ERROR", "very-critical").otherwise("Info")).alias("severity"), name("to_int", n).alias("whole"), name("epoch_s_to_utc", F.lit("1713182600")).alias("utc"),
    )


@query
def fn_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", sh.number_text(F.col("p_retailprice") * 1000).alias("number"), sh.percent_text(F.when(F.col("p_size") > 3, F.col("p_size") / 1000)).alias("percent"), sh.label_text(F.when(F.col("p_size") % 5 > 0, F.repeat("p_brand", F.col("p_size") % 5))).alias("label"))


@query
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return staging.keep_first(rows, "l_orderkey", ["l_shipdate", "l_linenumber", "l_partkey"])


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = files(spark, sf_dir, "key_value"), files(spark, sf_dir, "plain_text")
    kv = cut(readers.ingest(good, "key_value"))
    return staging.stage([kv, readers.ingest(bad, "key_value"), kv.where("line_number <= 5")])


@query
def stage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.totals(_staged(spark, sf_dir)).withColumn("success_rate", F.round("success_rate", 6))


@query
def stage_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.distribution(_staged(spark, sf_dir))


@query
def stage_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.per_source(_staged(spark, sf_dir))


@query
def stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.report(_staged(spark, sf_dir))


@query
def stage_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files that break off among good ones: told by file, and the job goes on."""
    good = files(spark, sf_dir, "csv")
    bad = good.select(F.concat(F.lit("bad-"), "source").alias("source"), F.encode(F.lit("a,b\n2,a\rb\n"), "UTF-8").alias("content"))
    return readers.errors(readers.ingest(good.unionByName(bad), "csv")).select("source", F.substring_index("error", ":", 1).alias("error"))


@query
def stage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _logfmt_records(spark, sf_dir)
    return staging.by_level(records, "error", "Warn").groupBy("level").agg(F.count("*").alias("n")).unionByName(staging.by_format(records, "logfmt").groupBy(F.col("format").alias("level")).agg(F.count("*").alias("n")))


@query
def stage_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = staging.select_records(_logfmt_records(spark, sf_dir), corrupted=False, level="error", fmt="logfmt", search="USER 1", where=F.col("line_number") % 2 == 0)
    return found.select("source", "line_number", "message")


def _logfmt_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.ingest(files(spark, sf_dir, "logfmt"), "logfmt")


@query
def stage_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, total, pages = staging.page(staging.sort_records(_logfmt_records(spark, sf_dir), "message", descending=True), 3, 25)
    return rows.select("message", "record_id", F.lit(total).alias("total"), F.lit(pages).alias("pages"))


@query
def export_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = sinks.pivot_fields(_logfmt_records(spark, sf_dir))
    return wide.select("record_id", "level", F.col("`field.user`").alias("user"), F.col("`field.cents`").alias("cents"))


for _agg in analyze.AGGREGATES:
    QUERIES[f"chart_{_agg}"] = (lambda a: lambda spark, sf_dir: (lambda df: df.withColumn("value", F.round("value", 4)) if a in ("sum", "avg") else df)(analyze.chart(table(spark, sf_dir, "orders"), "o_orderpriority", a, "o_totalprice", 25)))(_agg)


@query
def chart_top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.chart(table(spark, sf_dir, "orders"), "o_custkey", "count", None, 10)


@query
def profile_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.profile(table(spark, sf_dir, "customer"))


@query
def search_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.search(table(spark, sf_dir, "part"), "brand#1")[1]


@query
def search_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, every = analyze.search(table(spark, sf_dir, "part"), "brand", 5000)
    return first.agg(F.count("*").alias("shown")).crossJoin(every.agg(F.count("*").alias("found")))  # a row each


@query
def blob_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = facts(spark, sf_dir)
    return analyze.blob_preview(e.select("event_id", F.encode(F.repeat("message", (F.col("event_id") % 4).cast("int")), "UTF-8").alias("blob")))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry-like table out of parts."""
    p = table(spark, sf_dir, "part")
    keys = F.slice(F.array(*map(F.lit, ("timestamp", "tool_id", "alarm_code", "lot_id", "note"))), 1, (F.col("p_partkey") % 6).cast("int"))
    return p.select(
        F.format_string("sig%06d", "p_partkey").alias("signature"), F.when(F.col("p_partkey") % 11 > 0, F.col("p_type")).alias("format_type"), F.to_json(F.map_from_arrays(keys, keys)).alias("regex_patterns"),
        (F.col("p_size") * 2 / 100.0).alias("confidence"), (F.col("p_partkey") % 40).alias("hit_count"), F.format_string("2024-01-%02dT00:00:00", (F.col("p_partkey") % 28 + 1).cast("int")).alias("created_at"),
        F.when(F.col("p_partkey") % 3 == 0, F.format_string("2024-02-%02dT00:00:00", (F.col("p_partkey") % 28 + 1).cast("int"))).alias("updated_at"),
    )


def _viewed(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(analyze.registry_view(_registry(spark, sf_dir)))


@query
def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.registry_row(_registry(spark, sf_dir), "sig000123").select("signature", F.size("regex_patterns").alias("patterns"), F.try_element_at("regex_patterns", F.lit("tool_id")).alias("tool_id"))


@query
def registry_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _registry(spark, sf_dir)
    return semantic.signatures(r.unionByName(r))


@query
def listing_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.listing(_registry(spark, sf_dir), "mappings")


@query
def listing_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, _ = semantic.map_records(_vendor(spark, sf_dir), spark.createDataFrame([], REGISTRY))
    return analyze.listing(rows, "alarms")


QUERIES["registry_totals"] = _viewed(lambda v: analyze.registry_totals(v).withColumn("avg_confidence", F.round("avg_confidence", 6)))
QUERIES["registry_formats"] = _viewed(analyze.registry_formats)
QUERIES["registry_signals"] = _viewed(analyze.registry_signals)
QUERIES["registry_coverage"] = _viewed(analyze.registry_coverage)
QUERIES["registry_recent"] = _viewed(lambda v: analyze.recent_activity(v))
QUERIES["registry_watchlist"] = _viewed(analyze.watchlist)


@query
def lookup_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.get(F.array(*map(F.lit, ("TEMP", " ts ", "wafer_id", "alarm", "custom", "Level", "p"))), (F.col("event_id") % 7).cast("int"))
    return facts(spark, sf_dir).select(keys.alias("vendor")).withColumn("canonical", semantic.canonical_name(F.col("vendor"))).groupBy("vendor", "canonical").agg(F.count("*").alias("n"))


@query
def learned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as vendor names, stored, then some of them stored anew."""
    store = batch.Store(spark, f"{shared_dir(spark)}/names-{uuid.uuid4().hex}")
    nations = [(r.n_name, r.n_nationkey) for r in table(spark, sf_dir, "nation").collect()]  # a vocabulary
    store.learn_names({n: ("temperature", "pressure", "voltage")[k % 3] for n, k in nations})
    store.learn_names({n.lower(): "tool_id" for n, k in nations if k % 5 == 0})
    return store.table("field_mappings", FIELD_MAPPINGS).select("vendor_field", "canonical_field")


@query
def provider_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored of signatures for which the model failed for good."""
    provider = TextModel(call=_no_model, attempts=2, wait=_no_wait)
    _, signed, made = semantic.map_records(_vendor(spark, sf_dir), spark.createDataFrame([], REGISTRY), provider)
    return batch.unmapped(signed, made, provider.attempts, "now").select("signature", "log_source", "error", "attempts")


def _no_model(prompt: str) -> str:
    raise ConnectionError("no model here")


def _no_wait(seconds: float) -> None:
    return None


@query
def validated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = facts(spark, sf_dir)
    k = F.col("event_id")
    rows = e.select(
        k.cast("string").alias("record_id"), F.when(k % 2 == 0, F.col("message")).alias("raw_line"), F.when(k % 3 == 0, "odd").otherwise("alarm").alias("log_type"), F.when(k % 5 == 0, "loud").otherwise("info").alias("alarm_severity"),
        F.when(k % 7 == 0, "high").when(k % 7 == 1, "1.5").otherwise("0.5").alias("mapping_confidence"), F.lit("x").alias("parse_flags"), F.col("cents").alias("cents"),
    )
    return semantic.validate(rows).select("record_id", F.array_join("errors", ",").alias("errors"))


@query
def insert_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return sinks.new_rows(o, o.where(F.col("o_custkey") % 3 == 0), "o_custkey", ["o_orderdate", "o_orderkey"])


@query
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    fresh = c.where(F.col("c_custkey") % 4 == 0).select((F.col("c_custkey") + 60).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"), F.lit(-1).alias("c_nationkey"))
    return sinks.upsert(c, fresh, "c_custkey", keep=("c_nationkey",))


@query
def count_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("signature"), F.lit(5).cast("long").alias("hit_count"))
    return sinks.add_hits(c, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("signature")))


@query
def discover_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = facts(spark, sf_dir).select(F.col("event_id").alias("at"), F.concat_ws(" ", F.upper("event_type"), "message", F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("extra "), F.col("event_id").cast("string")))).alias("line"))
    return templates.discover_templates(lines).select("template", F.size("position_map").alias("wildcards"))


def _templates(spark: SparkSession) -> DataFrame:
    rows = [("t1", "user <*> did click", {0: "who"}), ("t2", "user <*> did <*>", {0: "who", 1: "what"}), ("t3", "<*> did error", {0: "who"}), ("t4", "nothing <*>", {0: "x"})]
    return spark.createDataFrame(rows, "signature string, template string, position_map map<int,string>")


@query
def match_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = facts(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("message").alias("line"))
    matched = templates.extract_values(templates.match_templates(lines, _templates(spark)).join(lines, "id"))
    return matched.select("id", "signature", F.try_element_at("values", F.lit("who")).alias("who"), F.try_element_at("values", F.lit("what")).alias("what"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_brand", F.lit("the 12")).alias("line"))


@query
def tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.fit(_texts(spark, sf_dir))[1].select("id", "term", F.round("w", 6).alias("w"))


@query
def nearest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _texts(spark, sf_dir)
    idf, _ = similar.fit(lines)
    got = similar.nearest(lines.where("id % 100 = 0"), lines, idf, 3)
    return got.select("id", "rank", F.round("cosine", 6).alias("cosine"))


@query
def cluster_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = similar.cluster(_texts(spark, sf_dir))
    return labels.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query
def cluster_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _texts(spark, sf_dir)
    labels = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 7 - 1).cast("int").alias("label"))
    return similar.representatives(lines, labels).select("id", "label")


def _vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = facts(spark, sf_dir)
    id_ = F.col("event_id")
    pairs = F.map_from_arrays(
        F.array(F.lit("Tool"), F.lit("TEMP"), F.when(id_ % 2 == 0, "alarm").otherwise("note"), F.lit("ts"), F.lit("raw_text"), F.lit("_x")),
        F.array(F.concat(F.lit("T"), (id_ % 5).cast("string")), F.concat((F.col("cents") % 3000).cast("string"), F.lit("F")), F.col("event_type"), F.col("iso"), F.col("message"), F.lit("hidden")),
    )
    return e.select(F.col("event_id").cast("string").alias("record_id"), F.lit("events").alias("log_source"), F.lit("json").alias("format"), pairs.alias("record"))


class Actions:
    """Patterns for the user and the action of the test lines."""

    def generate(self, lines, signatures):
        return [{"fields": {"status": r"did (\w+)", "wafer_id": r"user (\d+)", "lot_id": r"lot (\d+)"}, "confidence": 0.8, "parse_flags": []} for _ in lines]


@query
def semantic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = spark.createDataFrame([], REGISTRY)
    rows, _, _ = semantic.map_records(_vendor(spark, sf_dir), empty, Actions())
    extra = F.try_element_at("extra_fields", F.lit("note"))
    return rows.select("record_id", "tool_id", F.round("temperature", 6).alias("temperature"), "alarm_code", "timestamp", "raw_line", "log_type", "status", "wafer_id", "lot_id", "mapping_confidence", "dedup_key", extra.alias("note"), F.array_join("parse_flags", ",").alias("flags"))


@query
def semantic_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = spark.createDataFrame([], REGISTRY)
    _, signed, made = semantic.map_records(_vendor(spark, sf_dir), empty, Actions())
    return semantic.learn(empty, signed, made, "now").select("signature", "format_type", F.size("regex_patterns").alias("n_patterns"), "confidence", "hit_count")


@query
def anomaly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("record_id"), F.col("p_size").cast("double").alias("temperature"), F.col("p_retailprice").alias("pressure"), F.lit(None).cast("double").alias("rf_power"), F.lit(None).cast("double").alias("flow_rate"))
    told = anomaly.annotate(anomaly.score_records(p, anomaly.fit_forest(p)).withColumn("parse_flags", F.array().cast("array<string>")))
    return told.select("record_id", F.round("anomaly_score", 6).alias("anomaly_score"), F.size("parse_flags").alias("flags"))


@query
def page_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page far down the orders, read from its range, and the one that follows its last row."""
    orders = spread(table(spark, sf_dir, "orders")).select("o_custkey", "o_orderkey", "o_orderpriority")
    stored = pages.Pages.write(orders, f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}", ["o_custkey", "o_orderkey"], ranges=32)
    far = stored.page(10, 100)
    cursor = far.agg(F.max(F.struct("o_custkey", "o_orderkey")).alias("at")).first().at
    told = far.withColumn("page", F.lit(10))
    if cursor is not None:
        told = told.unionByName(stored.after(cursor, 100).withColumn("page", F.lit(11)))
    return told.withColumn("total", F.lit(stored.total()).cast("long"))


@query
def catalogue_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given tables as a store of the catalog: columns and rows of each from metadata."""
    stores = Catalogue(spark, sf_dir, prefix=f"tables_{uuid.uuid4().hex}_")
    told = stores.tables().select("table_name", "format", "n_columns", "n_rows")
    stores.close()
    return told


@query
def catalogue_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chart of a table that is found by its store's and its own name."""
    stores = Catalogue(spark, sf_dir, prefix=f"chart_{uuid.uuid4().hex}_")
    told = analyze.chart(stores.table("orders", stores.add(sf_dir, "Second.db")), "o_orderpriority", "sum", "o_totalprice")
    stores.close()
    return told.select("label", F.round("value", 2).alias("value"))


@query
def catalogue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text of all given tables that holds a word, with its table and column."""
    stores = Catalogue(spark, sf_dir, prefix=f"search_{uuid.uuid4().hex}_")
    told = stores.search("The")
    stores.close()
    return told


@query
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "1 hour")


@query
def generated_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generator's rows of each format, parsed back one by one and compared with their facts. Binary rows are chunks of 16 bytes; a lone delimiter line reads as a header."""
    content = F.coalesce("raw_payload", F.encode("raw_log", "UTF-8")).alias("content")
    logs = cut(spread(generator.tool_logs(spark)).select("format_type", F.col("signature").alias("source"), content, "event_ts", "lot_id"), "format_type")
    out = []
    for fmt in FORMATS:
        own = logs.where(F.col("format_type") == fmt)
        records = readers.ingest(own.select("source", "content"), fmt)
        told = own.select("source", "event_ts", "lot_id").join(records, "source", "left")
        lot = F.coalesce(*[F.try_element_at("fields", F.lit(k)) for k in ("lot", "@lot", "col_3")])
        out.append(told.agg(F.lit(fmt).alias("format"), F.count_distinct("source").alias("files"), F.count("record_id").alias("records"), F.count_if("corrupted").alias("corrupted"), F.count_if(F.col("timestamp") == F.col("event_ts")).alias("timed"), F.count_if(lot == F.col("lot_id")).alias("lots")))
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every
