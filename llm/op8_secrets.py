"""Secret scanning with linking of multipart credentials, in built-in functions only.

Strong findings stand alone: assignments of a value to a telling name, access keys, and
long runs of hex digits. Weak parts are reported only with a complement: an identifier or
an endpoint with a secret within `REACH` characters of the same text, and a bare secret
with an identifier, access key or endpoint there. The link is an interval join: parts are
dealt to cells of `CELL` characters of their text, a part looks into the cells that its
reach touches, and a left semi join keeps the weak parts that find a complement. Cells
bound the parts that meet, however long a text or its list of parts is.

Positions come from cutting the text at the pattern: gaps and matches alternate, so the
running sum of their lengths is the position in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import checkpointed, stored

REACH = 200
CELL = 1000

_TIE = r"""["']?\x20*[:=]\x20*["']?"""
#: Fixed by the contract of the query.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)" + _TIE + r"([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Weak parts, in the order in which a place is read.
IDENT = (r"(?i:\b(?:user_?name|user_?id|client_?id|account_?id|access_?key_?id|login)\b)"
         + _TIE + r"[A-Za-z0-9@._-]{3,}")
ENDPOINT = r"\bhttps?://[A-Za-z0-9._~:/?#@%&=+-]{4,}"
BARE = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}"
WEAK = f"(?:{IDENT})|(?:{ENDPOINT})|(?:{BARE})"

#: Kinds in the order of ties, and what each weak one needs near it.
KINDS = ("assign", "access", "hex", "ident", "endpoint", "bare")
COMPLEMENTS = {"ident": ("assign", "hex", "bare"), "endpoint": ("assign", "hex", "bare"),
               "bare": ("access", "ident", "endpoint")}

SPAN = "array<struct<start:int,rank:int,end:int>>"


def _located(text: Column, pattern: str, rank, value_group: int = 0, shortest: int = 0
             ) -> Column:
    """All matches as (start, rank, end); `rank` may depend on the match."""
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = match if not value_group else F.regexp_extract_all(
        text, F.lit(pattern), F.lit(value_group))
    lengths = F.transform(
        F.arrays_zip(F.split(text, pattern, -1).alias("gap"), match.alias("match"),
                     value.alias("value")),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"),
                           F.length(x["match"]).alias("size"),
                           F.length(x["value"]).alias("value"),
                           (rank(x["match"]) if callable(rank) else F.lit(rank))
                           .alias("rank")))
    none = F.lit(None).cast(SPAN)
    found = F.aggregate(
        F.filter(lengths, lambda x: x["size"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")),
        lambda seen, x: F.struct(
            (seen["at"] + x["gap"] + x["size"]).alias("at"),
            F.when((x["value"] >= shortest) & x["rank"].isNotNull(),
                   F.concat(seen["out"], F.array(F.struct(
                       (seen["at"] + x["gap"]).alias("start"), x["rank"].alias("rank"),
                       (seen["at"] + x["gap"] + x["size"]).alias("end")))))
            .otherwise(seen["out"]).alias("out")),
        lambda seen: seen["out"])
    return F.coalesce(F.when(text.rlike(pattern), found).otherwise(none),
                      F.array().cast(SPAN))


def _weak_rank(match: Column) -> Column:
    """Which weak part a match is; null for a bare run without digits and both cases."""
    varied = (match.rlike("[0-9]") & match.rlike("[a-z]") & match.rlike("[A-Z]"))
    return (F.when(match.rlike("^" + ENDPOINT), KINDS.index("endpoint"))
            .when(match.rlike("^" + IDENT), KINDS.index("ident"))
            .when(varied, KINDS.index("bare")))


def scan(docs: DataFrame) -> DataFrame:
    """`docs` with `strong` and `weak` parts and, where there are weak ones, a `row_key`
    of id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = docs.withColumns({
        "strong": F.array_sort(F.concat(
            _located(text, ASSIGN, KINDS.index("assign"), 2, 6),
            _located(text, ACCESS, KINDS.index("access")),
            _located(text, HEX, KINDS.index("hex")))),
        "weak": _located(text, WEAK, _weak_rank)})
    return parts.withColumn("row_key", F.when(F.size("weak") > 0, F.sha2(F.concat(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), text), 256)))


def link(scanned: DataFrame, reach: int = REACH, cell: int = CELL) -> DataFrame:
    """The weak parts with a complement in reach: row_key, linked (sorted array)."""
    held = (scanned.where("row_key is not null").select("row_key", "strong", "weak")
            .dropDuplicates(["row_key"]))
    parts = held.select("row_key", F.inline(F.concat("strong", "weak")))
    wide = parts.withColumns({"low": F.col("start") - reach, "high": F.col("end") + reach})
    own = parts.select("row_key", F.col("start").alias("a"), F.col("end").alias("b"),
                       F.col("rank").alias("of"), F.explode(F.sequence(
                           F.floor(F.col("start") / cell),
                           F.floor((F.col("end") - 1) / cell))).alias("cell"))
    looks = wide.where(F.col("rank").isin([KINDS.index(k) for k in COMPLEMENTS])).select(
        "*", F.explode(F.sequence(F.floor(F.col("low") / cell),
                                  F.floor((F.col("high") - 1) / cell))).alias("cell"))
    suits = F.lit(False)
    for weak, others in COMPLEMENTS.items():
        suits |= (F.col("rank") == KINDS.index(weak)) & F.col("of").isin(
            [KINDS.index(k) for k in others])
    near = (F.col("a") < F.col("high")) & (F.col("b") > F.col("low"))
    found = looks.alias("l").join(
        own.alias("o"), (F.col("l.row_key") == F.col("o.row_key"))
        & (F.col("l.cell") == F.col("o.cell")) & suits & near, "left_semi")
    return found.groupBy("row_key").agg(F.array_sort(F.collect_set(
        F.struct("start", "rank", "end"))).alias("linked"))


def with_links(scanned: DataFrame) -> DataFrame:
    """Adds `linked` to what `scan` gives, of which `scanned` should be a stored copy.

    Only rows with weak parts are joined; the others, which share no key, stay where
    they are.
    """
    none = F.array().cast(SPAN)
    weak = scanned.where("row_key is not null").join(link(scanned), "row_key", "left")
    return weak.withColumn("linked", F.coalesce("linked", none)).unionByName(
        scanned.where("row_key is null").withColumn("linked", none))


def find_secrets(docs: DataFrame) -> DataFrame:
    """`docs` with `strong` and `linked` findings: arrays of (start, rank, end), rank by
    `KINDS`, positions in code points of the text, ends exclusive.

    A null text is empty. Each row keeps its own result, repeated rows and rows without
    doc_id too. Columns of `docs` named strong, weak, row_key or linked are replaced. The
    scanned rows are stored once, so that the patterns run once.
    """
    return with_links(stored(scan(docs)))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scanned = checkpointed(scan(docs).drop("text"))
    found = with_links(scanned)

    def count(kind: str) -> Column:
        return F.size(F.filter("strong", lambda s: s["rank"] == KINDS.index(kind))
                      ).cast("long")

    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(_written(F.col("strong")), 256)
        .alias("base_sha256"),
        _written(F.array_sort(F.concat("strong", "linked"))).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with `mark` in place of each finding; overlapping ones are one.

    Rows without findings keep text and n_chars as they are; else n_chars, where there
    is one, is counted anew.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    aside = {c: f"_kept_{k}" for k, c in enumerate(others)}
    found = find_secrets(docs.withColumnsRenamed(aside))
    spans = F.array_sort(F.concat("strong", "linked"))
    text = F.col("text")
    pieces = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda seen, s: F.when(s["start"] >= seen["at"], F.struct(
            s["end"].alias("at"), F.concat(seen["out"], F.array(
                F.substring(text, seen["at"] + 1, s["start"] - seen["at"])))
            .alias("out")))
        .otherwise(F.struct(F.greatest(seen["at"], s["end"]).alias("at"),
                            seen["out"].alias("out"))),
        lambda seen: F.array_join(F.concat(seen["out"], F.array(
            F.substring(text, seen["at"] + 1, F.length(text)))), mark))
    new = found.withColumn("text", F.when(F.size(spans) > 0, pieces).otherwise(text))
    if "n_chars" in aside:
        old = F.col(aside["n_chars"])
        new = new.withColumn(aside["n_chars"], F.when(F.size(spans) > 0, F.length("text")
                             .cast(docs.schema["n_chars"].dataType)).otherwise(old))
    return new.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])
