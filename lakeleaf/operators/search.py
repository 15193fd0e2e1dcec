"""Full-text search over the index of ``segments``, or by ``scans`` where none is kept: BM25 phrase and token matches,
substring matches, and the cascade of attempts that merges them.

Engine tables: documents (id, source_id, external_id, title, url, ...), sections (id, document_id, ordinal, title,
heading_path, content), profiles (document_id, desc, retrieval_profile_json), feedback.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeleaf.functions import text as X
from lakeleaf.operators.feedback import targets, with_canonical, without_stale
from lakeleaf.operators.scans import Scan
from lakeleaf.operators.segments import Segments

DETAILS = ("none", "compact", "full")


@dataclass(frozen=True)
class Options:
    query: str
    limit: int = 20
    max_searches: int = 3
    max_sections_per_document: int = 2
    profile_detail: str = "compact"
    max_chars: int = 0
    detail: str = ""

    def clamped(self) -> Options:
        most = lambda v, default, top: default if v <= 0 else min(v, top)
        return replace(
            self, query=self.query.strip(), limit=self.limit if 0 < self.limit <= 200 else 20, max_searches=most(self.max_searches, 3, 5),
            max_sections_per_document=most(self.max_sections_per_document, 2, 5), profile_detail=self.profile_detail if self.profile_detail in DETAILS else "compact",
            max_chars=min(max(self.max_chars, 0), 4000),
        )

    @classmethod
    def preset(cls, query: str, limit: int = 20) -> Options:
        """What context packs and the plain search use."""
        return cls(query, limit, 5, 5, "compact")


@dataclass
class Result:
    query: str
    attempts: list[dict] = field(default_factory=list)
    hits: DataFrame | None = None

    @property
    def searches_used(self) -> int:
        return len(self.attempts)


# Query terms -----------------------------------------------------------------------------------------------------


def phrase_query(query: str) -> str:
    return '"' + query.replace('"', '""') + '"'


def query_words(query: str) -> list[str]:
    return [w for w in (f.strip(X.EDGES) for f in query.split()) if w]


def token_query(query: str) -> str:
    words = query_words(query)
    return " OR ".join(map(phrase_query, words)) if len(query.split()) >= 2 else ""


def has_han(text: str) -> bool:
    return bool(X.han_runs_of(text))


def substring_terms(query: str) -> list[str]:
    """The whole query and the 2- to 4-grams of its Han runs."""
    return list(dict.fromkeys(t for t in (query, *X.han_ngrams_of(query, 2, 4)) if t.strip()))


def profile_terms(query: str) -> list[str]:
    low = query.strip().lower()
    terms = dict.fromkeys((low, *query_words(low), *X.han_ngrams_of(low, 2, 4)))
    return [t for t in terms if len(t) >= 2 or any(c in t for c in "/_-")]


def search_terms(query: str) -> list[str]:
    low = query.strip().lower()
    return list(dict.fromkeys(t for t in (low, *query_words(low), *X.han_ngrams_of(low, 2, 4)) if t))


# Attempts ----------------------------------------------------------------------------------------------------------


def live(documents: DataFrame, profiles: DataFrame, feedback: DataFrame) -> DataFrame:
    """Documents that aren't stale, with canonical, desc and profile_json."""
    own = profiles.select(F.col("document_id").alias("id"), "desc", F.col("retrieval_profile_json").alias("profile_json"))
    rows = with_canonical(without_stale(documents, feedback), feedback).join(own, "id", "left")
    return rows.select(
        F.col("id").alias("document_id"), F.col("title").alias("document_title"), F.col("url").alias("document_url"), "canonical",
        F.coalesce("desc", F.lit("")).alias("desc"), F.coalesce("profile_json", F.lit("{}")).alias("profile_json"),
    )


def section_rows(sections: DataFrame) -> DataFrame:
    return sections.select(F.col("id").alias("section_id"), "document_id", "title", "heading_path", "content", "ordinal")


def numbered(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows with pos from 1. The limit comes first, so only that many rows meet in a task."""
    return rows.orderBy(*order).limit(limit).withColumn("pos", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))


#: section_id, document_id, rank, pos, term of a hit. There are 400 of them at most.
Place = tuple[str, str, float, int, "str | None"]
PLACES = "section_id string, document_id string, rank double, pos int, term string"


def match_places(index: Segments | Scan, feedback: DataFrame, phrases: list[list[str]], limit: int) -> list[Place]:
    """The best sections: those of canonical documents first, then the others by rank; none of stale ones.

    Only ids that feedback names are met, so documents and sections aren't read.
    """
    named = lambda kind: targets(feedback, kind).select(F.col("id").alias("document_id"))
    found = index.match(phrases, limit, named("document_canonical"), named("document_stale"))
    return [(s, d, rank, i + 1, None) for i, (_, rank, s, d) in enumerate(found)]


def _tests(terms: list[str], fields: tuple[str, ...]) -> Column:
    """The numbers of the terms that some field holds."""
    each = [F.when(reduce(Column.__or__, [X.contains_ascii_fold(F.col(c), t) for c in fields]), F.lit(i)) for i, t in enumerate(terms)]
    return F.filter(F.array(*each), lambda i: i.isNotNull())


def substring_places(index: Segments | Scan, sections: DataFrame, documents: DataFrame, feedback: DataFrame, profiles: DataFrame, terms: list[str], limit: int, in_profile: bool = False) -> list[Place]:
    """The same of sections that contain a term: each term gives at most ``limit``, in the order of the terms, each
    section once. Candidates come from the index's grams; only their texts, or their documents' profiles, are read."""
    titles = documents.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"))
    flagged = with_canonical(without_stale(titles, feedback, "document_id"), feedback, "document_id")

    def verified(ids: list[str], of: list[str]) -> set[tuple[str, int]]:
        own = section_rows(sections).filter(X.one_of("section_id", ids))
        if in_profile:
            texts = profiles.select("document_id", "desc", F.col("retrieval_profile_json").alias("profile_json"))
            own = own.join(texts.filter(X.one_of("document_id", of)), "document_id")
        else:
            own = own.join(titles.filter(X.one_of("document_id", of)), "document_id")
        hits = _tests(terms, ("desc", "profile_json") if in_profile else ("document_title", "title", "heading_path", "content"))
        return {(r["section_id"], i) for r in own.select("section_id", hits.alias("hits")).collect() for i in r["hits"]}

    found = index.substrings(terms, limit, flagged, verified, in_profile)
    once: dict[str, Place] = {}
    for no, _, section_id, document_id, ordinal in sorted(found):
        once.setdefault(section_id, (section_id, document_id, 1000.0 + ordinal, len(once) + 1, terms[no]))
    return list(once.values())[:limit]


def with_texts(places: list[Place], sections: DataFrame, documents: DataFrame) -> DataFrame:
    """Places with their sections' texts and their documents, looked up by id. documents: of ``live``."""
    texts = section_rows(sections).filter(X.one_of("section_id", (p[0] for p in places)))
    docs = documents.filter(X.one_of("document_id", (p[1] for p in places)))
    own = sections.sparkSession.createDataFrame([(s, *rest) for s, _, *rest in places], PLACES.replace("document_id string, ", ""))
    return F.broadcast(own).join(texts, "section_id").join(F.broadcast(docs), "document_id")


def plan_attempts(o: Options) -> list[tuple[str, str, list[str]]]:
    """(kind, match query, terms) of each attempt that the options allow, in order."""
    out = [("phrase", phrase_query(o.query), [])]
    tokens = token_query(o.query)
    if tokens and tokens != out[0][1]:
        out.append(("token", tokens, []))
    if has_han(o.query) and (terms := substring_terms(o.query)):
        out.append(("ngram", "", terms))
    if terms := profile_terms(o.query):
        out.append(("profile", "", terms))
    return out[: o.max_searches]


PROFILE = (
    "top_terms array<struct<term:string,tf:int,sections:int,heading_hits:int,title_hits:int,score:double>>, top_tags array<string>, keyphrases array<string>, aliases array<string>, "
    "api_refs array<string>, section_distribution array<struct<section_id:string,title:string,terms:array<string>,term_count:int>>, stats struct<token_count:int,section_count:int,unique_term_count:int>"
)


def _any_way(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def enriched(rows: DataFrame, terms: list[str], kind: str, o: Options) -> DataFrame:
    """Adds match (terms, fields, attempts, explanation), profile and retrieval_profile."""
    p = F.col("p")
    rows = rows.withColumn("p", F.from_json("profile_json", PROFILE))
    asked = F.array(*[F.lit(t) for t in terms]).cast("array<string>") if kind in ("phrase", "token") else F.array(F.lower("term"))
    text = F.lower(F.concat_ws("\n", "document_title", "desc", "title", "heading_path", "content"))
    none = F.array().cast("array<string>")
    listed = F.array_distinct(F.transform(F.concat(F.coalesce(F.transform(p["top_terms"], lambda t: t["term"]), none), *[F.coalesce(p[c], none) for c in ("top_tags", "keyphrases", "aliases", "api_refs")]), lambda v: F.lower(v)))
    in_profile = lambda t: F.exists(F.col("listed"), lambda v: _any_way(v, t))
    rows = rows.withColumn("listed", F.filter(listed, lambda v: v != "")).withColumn("asked", F.filter(F.transform(asked, lambda t: F.trim(F.lower(t))), lambda t: t != "")).withColumn("text", text)
    rows = rows.withColumn("matched", F.array_distinct(F.filter("asked", lambda t: F.contains(F.col("text"), t) | in_profile(t))))
    has = lambda c, t: F.contains(F.lower(F.col(c)), t)
    fields = F.flatten(F.transform("matched", lambda t: F.array(
        F.when(has("document_title", t), "title"), F.when(has("desc", t), "desc"), F.when(has("title", t) | has("heading_path", t), "heading"),
        F.when(has("content", t), "content"), F.when(in_profile(t), "profile"),
    )))
    fallback = {"ngram": "content", "profile": "profile"}.get(kind, "fts")
    rows = rows.withColumn("fields", F.array_distinct(F.array_compact(fields)))
    rows = rows.withColumn("fields", F.when(F.size("fields") == 0, F.array(F.lit(fallback))).otherwise(F.col("fields")))
    rows = rows.withColumn("matched", F.when(F.size("matched") == 0, F.array_distinct("asked")).otherwise(F.col("matched")))
    match = F.struct(F.col("matched").alias("matched_terms"), F.col("fields").alias("matched_fields"), F.array(F.lit(kind)).alias("search_attempts"), F.concat(F.lit("matched "), F.array_join("fields", ", ")).alias("score_explanation"))
    meets = lambda c: F.filter(F.coalesce(p[c], none), lambda v: F.exists("matched", lambda t: _any_way(F.lower(v), t)))
    compact = F.struct(F.slice(p["top_tags"], 1, 8).alias("top_tags"), F.slice(p["top_terms"], 1, 5).alias("top_terms"), F.col("matched").alias("matched_terms"), F.slice(meets("keyphrases"), 1, 5).alias("matched_keyphrases"))
    spread = F.coalesce(p["section_distribution"], F.from_json(F.lit("[]"), "array<struct<section_id:string,title:string,terms:array<string>,term_count:int>>"))
    own = F.filter(spread, lambda d: d["section_id"] == F.col("section_id"))
    near = F.filter(spread, lambda d: F.exists("matched", lambda t: F.contains(F.lower(F.concat_ws(" ", d["title"], F.array_join(d["terms"], " "))), t)))
    ordered = F.slice(F.array_distinct(F.concat(own, near, spread)), 1, 5)
    bounded = F.transform(ordered, lambda d: F.struct(d["section_id"].alias("section_id"), d["title"].alias("title"), F.slice(d["terms"], 1, 8).alias("terms"), d["term_count"].alias("term_count")))
    full = F.struct(
        F.slice(p["top_terms"], 1, 20).alias("top_terms"), F.slice(p["top_tags"], 1, 12).alias("top_tags"), F.slice(p["keyphrases"], 1, 20).alias("keyphrases"), F.slice(p["aliases"], 1, 10).alias("aliases"),
        F.slice(p["api_refs"], 1, 20).alias("api_refs"), F.slice("matched", 1, 20).alias("matched_terms"), bounded.alias("section_distribution"), p["stats"].alias("stats"),
    )
    rows = rows.withColumn("match", match).withColumn("profile", compact).withColumn("retrieval_profile", full)
    return rows.drop("p", "listed", "asked", "text", "matched", "fields", "profile_json")


@F.pandas_udf(T.StringType())
def _window_snippet(content: pd.Series, phrases: pd.Series) -> pd.Series:
    return pd.Series([X.window_snippet(c, [list(p) for p in ps]) for c, ps in zip(content, phrases)])


@F.pandas_udf(T.StringType())
def _term_snippet(content: pd.Series, term: pd.Series) -> pd.Series:
    return pd.Series([X.term_snippet(c, t) for c, t in zip(content, term)])


@F.pandas_udf(T.StringType())
def truncated(content: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([X.truncate_paragraphs(c, int(m)) for c, m in zip(content, most)])


def collect(attempts: list[DataFrame], o: Options) -> DataFrame:
    """Merge the attempts' rows: the first place of a section counts, later finds only add to its match; then at most
    so many sections of a document, and ``limit`` in all. attempts: with attempt_no and pos."""
    rows = reduce(lambda a, b: a.unionByName(b), attempts)
    first = [F.col("attempt_no"), F.col("pos")]
    w = W.partitionBy("section_id").orderBy(*first)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    for part in ("matched_terms", "matched_fields", "search_attempts"):
        rows = rows.withColumn(part, F.array_distinct(F.flatten(F.collect_list(F.col("match")[part]).over(whole))))
    rows = rows.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
    match = F.struct("matched_terms", "matched_fields", "search_attempts", F.col("match")["score_explanation"].alias("score_explanation"))
    rows = rows.withColumn("match", match).drop("matched_terms", "matched_fields", "search_attempts")
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("document_id").orderBy(*first))).filter(F.col("nth") <= o.max_sections_per_document).drop("nth")
    rows = rows.orderBy(*first).limit(o.limit).withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*first)))
    if o.detail == "summary":
        nothing = lambda c: F.lit(None).cast(rows.schema[c].dataType)
        return rows.withColumn("content", F.lit("")).withColumn("desc", F.lit("")).withColumns({c: nothing(c) for c in ("match", "profile", "retrieval_profile")})
    if o.max_chars > 0:
        rows = rows.withColumn("content", truncated("content", F.lit(o.max_chars)))
    drop = {"none": ("profile", "retrieval_profile"), "compact": ("retrieval_profile",), "full": ()}[o.profile_detail]
    rows = rows.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in drop})
    return rows.withColumn("desc", F.lit("")) if o.profile_detail == "none" else rows


def search(options: Options, index: Segments | Scan, sections: DataFrame, documents: DataFrame, profiles: DataFrame, feedback: DataFrame) -> Result:
    """The attempts in order, merged. A blank query has no attempts and hits None."""
    o = options.clamped()
    if not o.query:
        return Result("")
    docs = live(documents, profiles, feedback)
    frames, said = [], []
    for no, (kind, query, terms) in enumerate(plan_attempts(o)):
        if kind in ("phrase", "token"):
            phrases = [X.index_tokens_of(p) for p in ([o.query] if kind == "phrase" else query_words(o.query))]
            places = match_places(index, feedback, phrases, 2 * o.limit)
            snippet = _window_snippet("content", F.from_json(F.lit(json.dumps(phrases)), "array<array<string>>"))
        else:
            places = substring_places(index, sections, documents, feedback, profiles, terms, 2 * o.limit, kind == "profile")
            snippet = _term_snippet("content", "term")
        rows = with_texts(places, sections, docs).withColumn("snippet", snippet)
        rows = enriched(rows, search_terms(o.query), kind, o).withColumn("attempt_no", F.lit(no)).drop("term")
        said.append({"kind": kind, "query": query, "terms": terms} | {"hits": len(places)})
        frames.append(rows)
    return Result(o.query, said, collect(frames, o))

