"""Raw transfer files: typed CSV, pattern blocks, standard schema, validation, pattern matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

USD = "US Dollar"
#: The raw header (one name appears twice) and the fields by position.
HEADER = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering"
FIELDS = (
    ("time", T.StringType()), ("from_bank", T.StringType()), ("from_account", T.StringType()), ("to_bank", T.StringType()),
    ("to_account", T.StringType()), ("amount_received", T.DoubleType()), ("recv_currency", T.StringType()), ("amount_paid", T.DoubleType()),
    ("pay_currency", T.StringType()), ("payment_format", T.StringType()), ("is_fraud", T.ByteType()),
)
TIME = "yyyy/MM/dd HH:mm"
KEY = ["timestamp", "src", "dst", "amount_paid", "pay_currency", "amount_received", "recv_currency", "payment_format"]

#: Rows of a range of positions at least, ranges at most; entries of a vocabulary that are broadcast at most.
RANGE_ROWS, RANGES, WORDS = 100_000, 100_000, 100_000


class DataValidationError(ValueError):
    """Input that breaks its contract."""


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """The 11 fields by position and ``raw_row``, the row's place in the file, from 0.

    Types are declared, so bank codes 001 and 01 stay apart.  File order comes
    from the byte order of the text splits: counts a partition, cumulated, plus
    the place within it.
    """
    lines = spark.read.text(path).withColumn("mid", F.monotonically_increasing_id())
    head = lines.orderBy("mid").first()
    if head is None or head["value"].strip() != HEADER:
        raise DataValidationError(f"unexpected header: {None if head is None else head['value']}")
    body = lines.where((F.trim("value") != "") & (F.trim("value") != HEADER))
    placed = body.withColumn("part", F.shiftright("mid", 33)).withColumn("at", F.col("mid").bitwiseAND(F.lit((1 << 33) - 1)))
    numbered = placed.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("at")) - 1)
    sizes = placed.groupBy("part").count()  # a row a partition
    base = sizes.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    schema = T.StructType([T.StructField(n, t) for n, t in FIELDS])
    rows = numbered.join(F.broadcast(base), "part").select((F.col("base") + F.col("k")).alias("raw_row"), "value")
    return rows.select("raw_row", F.from_csv("value", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")).alias("f")).select("raw_row", "f.*")


def _accounts(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "timestamp": F.to_timestamp_ntz("time", F.lit(TIME)),
        "src": F.concat_ws("_", "from_bank", "from_account"),
        "dst": F.concat_ws("_", "to_bank", "to_account"),
    })


def usd_rates(raw: DataFrame) -> DataFrame:
    """currency, rate: US dollars a unit, the median over rows that change to or from dollars."""
    ratio = F.log(F.col("amount_received") / F.col("amount_paid"))
    cross = raw.where("pay_currency <> recv_currency")
    to = cross.where(F.col("recv_currency") == USD).select(F.col("pay_currency").alias("currency"), ratio.alias("x"))
    back = cross.where(F.col("pay_currency") == USD).select(F.col("recv_currency").alias("currency"), (-ratio).alias("x"))
    rates = to.unionAll(back).where(F.col("currency") != USD).groupBy("currency").agg(F.exp(F.percentile("x", F.lit(0.5))).alias("rate"))
    one = raw.sparkSession.createDataFrame([(USD, 1.0)], "currency string, rate double")
    return rates.unionAll(one)


def to_standard(raw: DataFrame, variant: str, tail_cutoff: str, rate_fit_end: str) -> DataFrame:
    """The standard schema in order of (timestamp, raw row); rows from ``tail_cutoff`` on are dropped.

    Rates come from rows before ``rate_fit_end`` only.  A payment currency
    without a rate is an error.
    """
    rows = _accounts(raw)
    rates = usd_rates(rows.where(F.col("timestamp") < F.lit(rate_fit_end).cast("timestamp_ntz")))
    known = rows.join(F.broadcast(rates), rows.pay_currency == rates.currency, "left")
    missing = known.where("rate is null").select("pay_currency").distinct().limit(20).collect()
    if missing:
        raise DataValidationError(f"no dollar rate for {sorted(r[0] for r in missing)}")
    flag = lambda c: c.cast("byte")
    kept = known.where(F.col("timestamp") < F.lit(tail_cutoff).cast("timestamp_ntz"))
    return kept.select(
        F.concat(F.lit(variant + ":"), F.lpad(F.col("raw_row").cast("string"), 7, "0")).alias("tx_id"), "src", "dst",
        (F.col("amount_paid") * F.col("rate")).alias("amount"), "timestamp", "is_fraud",
        F.col("from_bank").alias("src_bank"), F.col("to_bank").alias("dst_bank"), "amount_paid", "pay_currency", "amount_received", "recv_currency",
        "payment_format", flag(F.col("src") == F.col("dst")).alias("is_self_transfer"),
        flag(F.col("from_bank") != F.col("to_bank")).alias("is_cross_bank"), flag(F.col("pay_currency") != F.col("recv_currency")).alias("is_cross_currency"), "raw_row",
    ).orderBy("timestamp", "raw_row").drop("raw_row")


def load_report(raw: DataFrame, standard: DataFrame) -> DataFrame:
    """One row of counts: raw, kept, dropped, positives, accounts, duplicates."""
    fields = [n for n, _ in FIELDS]
    before = raw.agg(F.count("*").alias("n_raw"), F.sum("is_fraud").alias("pos_raw"), (F.count("*") - F.count_distinct(F.struct(*fields))).alias("n_duplicates"))
    after = standard.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("is_fraud"), F.lit(0)).alias("n_pos"))
    accounts = standard.select("src").union(standard.select("dst")).agg(F.count_distinct("src").alias("n_accounts"))
    return before.crossJoin(after).crossJoin(accounts).select(
        "n_raw", "n_rows", (F.col("n_raw") - F.col("n_rows")).alias("n_dropped_tail"), (F.col("pos_raw") - F.col("n_pos")).alias("pos_dropped_tail"), "n_pos", "n_accounts", "n_duplicates"
    )


def problems(df: DataFrame, tail_cutoff: str | None = None) -> list[str]:
    """All breaches of the standard contract, from one pass."""
    cols = df.columns
    nulls = [F.count_if(F.col(c).isNull()).alias("null " + c) for c in cols]
    tail = F.count_if(F.col("timestamp") >= F.lit(tail_cutoff).cast("timestamp_ntz")) if tail_cutoff else F.lit(0)
    found = df.agg(
        *nulls, F.count_if((F.col("amount") <= 0) | F.isnan("amount")).alias("non-positive amounts"), (F.count("*") - F.count_distinct("tx_id")).alias("duplicate ids"),
        F.count_if(~F.col("is_fraud").isin(0, 1)).alias("labels outside 0 and 1"), tail.alias("rows in the tail"),
    ).first()
    return [f"{k}: {v}" for k, v in found.asDict().items() if v]


def out_of_order(df: DataFrame, position: str, time: str = "timestamp") -> DataFrame:
    """Rows whose time is before that of an earlier source position.

    Tables have no order, so the check is against the row number of the source.
    Within a range of positions a running maximum serves; ranges meet by their
    maxima, one row each, of which there are no more than ``RANGES``.
    """
    last = df.agg(F.max(position)).first()[0] or 0
    size = max(RANGE_ROWS, int(last) // RANGES + 1)
    placed = df.withColumn("__range", F.floor(F.col(position) / size))
    tops = placed.groupBy("__range").agg(F.max(time).alias("__top"))
    before = tops.select("__range", F.max("__top").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    inside = Window.partitionBy("__range").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    seen = placed.withColumn("__inside", F.max(time).over(inside)).join(F.broadcast(before), "__range")
    late = F.col(time) < F.greatest("__inside", "__before")
    return seen.where(late).drop("__range", "__inside", "__before")


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """One row a pattern transfer: pattern_id (block number), typology, detail and the fields of a raw row.

    Pattern files are small side files of one document, so a file is read whole.
    """
    text = spark.read.text(path, wholetext=True).withColumn("lines", F.split("value", r"\r?\n"))
    lines = text.select(F.posexplode("lines").alias("i", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    order = Window.orderBy("i")
    begin, end = F.col("line").startswith("BEGIN"), F.col("line").startswith("END")
    state = lines.withColumns({
        "begin": begin, "end": end, "block": F.sum(begin.cast("int")).over(order) - 1,
        "open": F.sum(begin.cast("int") - end.cast("int")).over(order), "fields": F.split("line", ","),
    })
    bad = state.where(
        ~F.col("open").isin(0, 1) | (F.col("begin") & ~F.col("line").rlike(r"^BEGIN LAUNDERING ATTEMPT - [A-Z-]+")) | (~F.col("begin") & ~F.col("end") & ((F.col("open") != 1) | (F.size("fields") != len(FIELDS))))
    ).limit(1).collect()
    last = state.orderBy(F.desc("i")).first()
    if bad or (last is not None and last["open"] != 0):
        raise DataValidationError(f"malformed pattern file: {bad[0]['line'] if bad else 'last block has no END'}")
    head = r"^BEGIN LAUNDERING ATTEMPT - ([A-Z-]+):?\s*(.*)$"
    heads = state.where("begin").select("block", F.regexp_extract("line", head, 1).alias("typology"), F.trim(F.regexp_extract("line", head, 2)).alias("detail"))
    rows = state.where("not begin and not end").select("block", "i", *[F.col("fields")[k].cast(t).alias(n) for k, (n, t) in enumerate(FIELDS)])
    return _accounts(rows).join(heads, "block").select(
        F.col("block").cast("int").alias("pattern_id"), "typology", "detail", "timestamp", "src", "dst", "amount_paid", "pay_currency", "amount_received", "recv_currency", "payment_format", "is_fraud"
    )


def match_patterns(tx: DataFrame, patterns: DataFrame, tail_cutoff: str) -> DataFrame:
    """Pattern rows with the tx_id they match on all shared fields; null for rows in the dropped tail.

    Refuses rows labelled 0, several matches, matches of negative transfers,
    missing matches before the cut-off, and transfers in two patterns.
    """
    right = tx.select(*KEY, "tx_id", F.col("is_fraud").alias("tx_label"))
    found = patterns.withColumn("__row", F.monotonically_increasing_id()).join(right, KEY, "left")
    early = F.col("timestamp") < F.lit(tail_cutoff).cast("timestamp_ntz")
    checks = found.agg(
        F.count_if(F.col("is_fraud") != 1).alias("rows labelled 0"), (F.count("*") - F.count_distinct("__row")).alias("rows with several matches"),
        F.count_if(F.col("tx_label") == 0).alias("matches of negative transfers"), F.count_if(F.col("tx_id").isNull() & early).alias("unmatched rows before the cut-off"),
        (F.count("tx_id") - F.count_distinct("tx_id")).alias("transfers in two patterns"),
    ).first().asDict()
    wrong = [f"{k}: {v}" for k, v in checks.items() if v]
    if wrong:
        raise DataValidationError("; ".join(wrong))
    return found.drop("__row", "tx_label")


def pattern_report(matched: DataFrame) -> DataFrame:
    """One row: patterns, those cut by the tail and those wholly in it."""
    own = matched.groupBy("pattern_id").agg(F.bool_or(F.col("tx_id").isNull()).alias("cut"), F.every(F.col("tx_id").isNull()).alias("gone"))
    return own.agg(F.count("*").alias("n_patterns"), F.count_if(F.col("cut") & ~F.col("gone")).alias("n_truncated"), F.count_if("gone").alias("n_in_tail"))


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """``df`` with <column>_code: place in the sorted vocabulary, -1 for null.

    The vocabulary is broadcast up to ``WORDS`` entries, and joined by key beyond.
    """
    words = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("__c", F.row_number().over(Window.orderBy(column)) - 1)
    small = words.limit(WORDS + 1).count() <= WORDS
    return df.join(F.broadcast(words) if small else words, column, "left").withColumn(f"{column}_code", F.coalesce("__c", F.lit(-1))).drop("__c")


def tabular_features(df: DataFrame) -> DataFrame:
    """Row features: log amount, hour, category codes, flags, whole hundreds."""
    for c in ("payment_format", "pay_currency", "recv_currency"):
        df = category_codes(df, c)
    code: list[Column] = [F.col(f"{c}_code").alias(c) for c in ("payment_format", "pay_currency", "recv_currency")]
    return df.select(
        "tx_id", F.log1p("amount").alias("log_amount"), F.hour("timestamp").alias("hour"), *code, "is_cross_currency", "is_cross_bank", "is_self_transfer",
        (F.col("amount_paid") % 100 == 0).cast("int").alias("is_round_amount"),
    )


def load_steps(features: DataFrame, classes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with time step and nullable label, and edges, of a dataset of labelled steps.

    Columns are found by name.  Refuses repeated ids, nodes without a class,
    dangling edges and edges across steps.
    """
    named = lambda df, *words: next(c for c in df.columns if all(w in c.lower().replace(" ", "_") for w in words))
    fid, step, cid, cls = named(features, "id"), named(features, "step"), named(classes, "id"), named(classes, "class")
    source, target = edges.columns[:2]
    text = F.lower(F.trim(F.col(cls).cast("string")))
    label = F.when(text.isin("1", "illicit"), 1.0).when(text.isin("2", "licit"), 0.0)
    labels = classes.select(F.col(cid).alias(fid), label.alias("y"), text.alias("__class"))
    nodes = features.join(labels, fid, "left").withColumnsRenamed({fid: "tx_id", step: "step"})
    counts = nodes.agg((F.count("*") - F.count_distinct("tx_id")).alias("repeated ids"), F.count_if(F.col("step").isNull()).alias("missing steps"), F.count_if(F.col("__class").isNull()).alias("missing classes")).first().asDict()
    ends = edges.select(F.col(source).alias("src"), F.col(target).alias("dst"))
    of = lambda end: nodes.select(F.col("tx_id").alias(end), F.col("step").alias("step_" + end))
    both = ends.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    counts |= both.agg(F.count_if(F.col("step_src").isNull() | F.col("step_dst").isNull()).alias("dangling edges"), F.count_if(F.col("step_src") != F.col("step_dst")).alias("edges across steps")).first().asDict()
    wrong = [f"{k}: {v}" for k, v in counts.items() if v]
    if wrong:
        raise DataValidationError("; ".join(wrong))
    return nodes.drop("__class"), ends
