"""Operator 12, secret scans, with DataFrame functions only.

Candidates are found by patterns. What they are is decided by who has them: their hashes are counted by distinct
owners and repositories over the whole corpus. A value that several owners have is an example copied from some manual;
one that a single owner has, and that looks random, is a credential that may live. Kinds that name their secrets are
reported either way; long random-looking words without a name are reported only where a single owner has them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakeleaf.llm.common import materialise, salt

#: The patterns of the base kinds, the group that is the secret, its least length (of access the match's).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"


class Kind(NamedTuple):
    name: str
    pattern: str
    group: int
    least: int
    base: bool


#: A word without a name must have capital and small letters, digits and 12 different signs to be a candidate. The long
#: runs of the last two kinds are asked for by length, so that the words of a text aren't matches that are then dropped.
KINDS = (
    Kind("assign", ASSIGN, 2, 6, True),
    Kind("access", ACCESS, 0, 20, True),
    Kind("hex", HEX.replace("+", "{24,}"), 0, 24, True),
    Kind("word", "[A-Za-z0-9_+-]{20,}", 0, 20, False),
)
LEAST_SIGNS = 12


class Settings(NamedTuple):
    """copied: a value of so many owners is an example. random: a live-looking value has so many different signs."""

    copied: int = 3
    random: int = 10


def _signs(value: Column) -> Column:
    return F.size(F.array_distinct(F.split(value, "")))


def candidates(docs: DataFrame, owner: Column, repository: Column, settings: Settings, text: str, doc_id: str) -> DataFrame:
    """Written: row_id, doc_id, owner, repository, found: (kind, at, gap, long, ok, hash, random) of each match. gap is what
    lies between a match and the one of its kind before it."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    named = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(doc_id).cast("long").alias("doc_id"), named(owner).alias("owner"), named(repository).alias("repository"), whole.alias("text"))
    rows = rows.withColumns({f"hits{k}": F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(0)) for k, kind in enumerate(KINDS)})

    def matches(k: int, kind: Kind) -> Column:
        hits = F.col(f"hits{k}")
        values = F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(kind.group)) if kind.group else hits
        gaps = F.transform(F.slice(F.split("text", kind.pattern, -1), 1, F.size(hits)), lambda g: F.length(g))

        def match(both: Column, at: Column) -> Column:
            hit, value = both["hit"], both["value"]
            ok = F.length(value) >= kind.least
            if not kind.base:
                ok &= value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]") & (_signs(value) >= LEAST_SIGNS)
            random = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (_signs(value) >= settings.random)
            return F.struct(F.lit(k).alias("kind"), at.alias("at"), both["gap"].alias("gap"), F.length(hit).alias("long"), ok.alias("ok"), F.unhex(F.sha2(value, 256)).alias("hash"), random.alias("random"))

        zipped = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value"))
        return F.when(F.size(hits) > 0, F.transform(zipped, match))

    # Null where a kind has no match; nothing else is worked out then.
    rows = rows.select("row_id", "doc_id", "owner", "repository", F.array(*[matches(k, kind) for k, kind in enumerate(KINDS)]).alias("each"))
    found = F.flatten(F.filter("each", lambda x: x.isNotNull()))
    return materialise(rows.select("row_id", "doc_id", "owner", "repository", found.alias("found")), "secret-rows")


def placed(rows: DataFrame) -> DataFrame:
    """Written: row_id, owner, repository, kind, start, end, hash, random, salt: candidates, without those of no base kind
    that overlap one of a base kind."""
    each = rows.filter(F.size("found") > 0).select("row_id", "owner", "repository", F.explode("found").alias("f")).select("row_id", "owner", "repository", "f.*")
    each = each.repartition("row_id")  # all windows go by it: one exchange
    so_far = F.sum(F.col("gap").cast("long") + F.col("long")).over(Window.partitionBy("row_id", "kind").orderBy("at"))
    each = each.withColumn("end", so_far).withColumn("start", F.col("end") - F.col("long")).filter("ok")
    base = F.col("kind").isin([k for k, kind in enumerate(KINDS) if kind.base])
    one = Window.partitionBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("reached", F.max(F.when(base, F.col("end"))).over(one.orderBy("start", "kind", "end")))
    each = each.withColumn("next", F.min(F.when(base, F.col("start"))).over(one.orderBy(F.desc("start"), F.desc("kind"), F.desc("end"))))
    free = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end")))
    return materialise(each.filter(base | free).select("row_id", "owner", "repository", "kind", "start", "end", "hash", "random", salt("row_id").alias("salt")), "secret-spans")


def ownership(spans: DataFrame, settings: Settings) -> DataFrame:
    """hash, salt, n_owners, n_repositories, n, verdict: one row for each salt of a candidate that has rows.

    A hash of a third of all rows is summed in each task before it is shuffled, by repository, then by owner.
    """
    seen = materialise(spans.groupBy("hash", "owner", "repository", "salt").agg(F.count("*").alias("n"), F.max("random").alias("random")), "secret-owners")
    by_repository = seen.groupBy("hash", "owner", "repository").agg(F.sum("n").alias("n"), F.max("random").alias("random"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count("*").alias("n_repositories"), F.sum("n").alias("n"), F.max("random").alias("random"))
    known = by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n_repositories").alias("n_repositories"), F.sum("n").alias("n"), F.max("random").alias("random"))
    verdict = F.when(F.col("n_owners") >= settings.copied, "example").when((F.col("n_owners") == 1) & F.col("random"), "live").otherwise("unsure")
    known = known.select("hash", "n_owners", "n_repositories", "n", verdict.alias("verdict"))
    return seen.select("hash", "salt").distinct().join(known, "hash")


def _judged(docs: DataFrame, owner: Column, repository: Column, settings: Settings, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    rows = candidates(docs, owner, repository, settings, text, doc_id)
    spans = placed(rows)
    judged = spans.join(ownership(spans, settings), ["hash", "salt"])
    base = F.element_at(F.array(*[F.lit(kind.base) for kind in KINDS]), F.col("kind") + 1)
    return rows, judged.withColumn("base", base).filter(F.col("base") | (F.col("verdict") == "live"))


def name_of(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(kind.name) for kind in KINDS]), kind + 1)


def secret_spans(docs: DataFrame, owner: Column, repository: Column, settings: Settings = Settings(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, kind, start, end, value_sha256, n_owners, n_repositories, n, verdict: the secrets of every whole text.

    start and end (exclusive) are in code points. Verdicts: ``example`` (at least ``copied`` owners have the value),
    ``live`` (one owner has it and it looks random), else ``unsure``. Spans of kind ``word`` are live ones beside those of
    base kinds. Null texts, owners and repositories are empty ones; a null id stays null. Repeated rows are repeated and
    count as the same repository's. An empty table gives an empty result, and other columns are ignored. A very long text
    is matched whole; its spans meet in one task, by windows that spill.
    """
    rows, judged = _judged(docs, owner, repository, settings, text, doc_id)
    found = judged.join(rows.select("row_id", "doc_id"), "row_id")
    return found.select("doc_id", name_of(F.col("kind")).alias("kind"), "start", "end", F.lower(F.hex("hash")).alias("value_sha256"), "n_owners", "n_repositories", "n", "verdict")


def secret_digests(docs: DataFrame, owner: Column, repository: Column, settings: Settings = Settings(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    ``spans`` are kind:start:end of ``secret_spans`` by start, then kind, joined by commas; base_sha256 is the digest of
    those of base kinds so joined. n_live and n_example count spans by verdict. Odd rows as in ``secret_spans``.
    """
    rows, judged = _judged(docs, owner, repository, settings, text, doc_id)
    span = F.struct("start", "kind", "end")
    listed = lambda wanted: F.sort_array(F.collect_list(F.when(wanted, span)))
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{kind.name}") for k, kind in enumerate(KINDS) if kind.base]
    verdicts = [F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("live", "example")]
    own = judged.groupBy("row_id").agg(listed(F.col("base")).alias("base"), listed(F.lit(True)).alias("all"), *counts, *verdicts)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name_of(s["kind"]), s["start"], s["end"])), ",")
    own = own.select("row_id", joined(F.col("base")).alias("base"), joined(F.col("all")).alias("spans"), *[f"n_{kind.name}" for kind in KINDS if kind.base], "n_live", "n_example")
    out = rows.select("row_id", "doc_id").join(own, "row_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        "doc_id", *[zero(f"n_{kind.name}") for kind in KINDS if kind.base], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_live"), zero("n_example"),
    )
