"""URL filter: allow and block rules, and a weighted vocabulary found by Aho-Corasick."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCHEMA = "page_id long, host string, path string, rule string, verdict string, strict_hits long, soft_hits long, soft_weight long"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host with its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Vocabulary:
    """Terms in lower case, the soft ones with their weights. One strict term rejects, and so do distinct soft terms whose
    weights reach ``needed``. A soft term weighs less than that, so it never rejects by itself."""

    strict: tuple[str, ...]
    soft: tuple[tuple[str, int], ...]
    needed: int = 4

    def __post_init__(self) -> None:
        if not all(0 < weight < self.needed for _, weight in self.soft):
            raise ValueError("a soft term weighs more than nothing and less than what is needed")
        if not all(self.strict) or not all(term for term, _ in self.soft):
            raise ValueError("a term has a character at least")


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
_SOFT = (
    "ads", "bet", "bets", "bonus", "cheap", "dating", "farm", "free", "jackpot", "loan", "nude", "pills", "sex",
    "spam", "torrent", "track", "warez", "win",
)
_SOFTER = ("click", "coupon", "deal", "deals", "hot", "lucky", "prize", "promo", "vip")
VOCABULARY = Vocabulary(
    strict=("adult", "casino", "escort", "gambling", "hentai", "malware", "phishing", "poker", "porn", "viagra", "xxx"),
    soft=(*((term, 2) for term in _SOFT), *((term, 1) for term in _SOFTER)),
)

#: Terms that a table may have: the automaton travels to every task.
MOST_TERMS = 200_000


def vocabulary_of(terms: DataFrame, needed: int = 4) -> Vocabulary:
    """The vocabulary of a table ``term, weight``; a term that weighs ``needed`` or more is strict.

    A-Z of a term are lower-cased. Of equal terms the greatest weight counts; null and empty terms, and terms of no
    positive weight, are left out. More than ``MOST_TERMS`` terms are refused, never cut.
    """
    lowered = F.translate("term", UPPER, LOWER).alias("term")
    kept = terms.where("term <> '' and weight > 0").select(lowered, F.col("weight").cast("long").alias("weight"))
    rows = kept.groupBy("term").agg(F.max("weight").alias("weight")).limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    ordered = sorted((row.term, row.weight) for row in rows)
    strict = tuple(term for term, weight in ordered if weight >= needed)
    return Vocabulary(strict, tuple((term, weight) for term, weight in ordered if weight < needed), needed)


def host_of(url: Column) -> Column:
    """What stands behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as struct (rule, verdict); null if none does."""
    longest_first = sorted(rules, key=lambda rule: len(rule.name), reverse=True)
    fitting = [
        F.when(
            ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path)),
            F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict")),
        )
        for rule in longest_first
    ]
    return F.coalesce(*fitting, F.lit(None).cast("struct<rule:string,verdict:string>"))


def _automaton(vocabulary: Vocabulary) -> ahocorasick.Automaton:
    """Each term with its weight, 0 for strict ones, which go before equal soft ones."""
    found = ahocorasick.Automaton()
    for term, weight in (*vocabulary.soft, *((term, 0) for term in vocabulary.strict)):
        found.add_word(term, (weight, term))
    found.make_automaton()
    return found


def hits(url: str, automaton: ahocorasick.Automaton) -> tuple[int, int, int]:
    """Strict hits, distinct soft terms and their weight; a hit is touched by no ASCII letter or digit of the url."""
    text = url.lower() if url.isascii() else "".join(c.lower() if c.isascii() else c for c in url)
    strict, soft = 0, {}
    for last, (weight, term) in automaton.iter(text) if len(automaton) else ():
        first = last - len(term) + 1
        if (first and _joins(text[first - 1])) or (last + 1 < len(text) and _joins(text[last + 1])):
            continue
        if weight:
            soft[term] = weight
        else:
            strict += 1
    return strict, len(soft), sum(soft.values())


def _joins(character: str) -> bool:
    return character.isascii() and character.isalnum()


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule] = RULES, vocabulary: Vocabulary = VOCABULARY
) -> DataFrame:
    """One row per row of ``pages`` (``page_id``, ``url``): host, path, the rule that fits and the verdict.

    A rule's verdict goes before the vocabulary's. Without a rule, one strict term or distinct soft terms of weight
    ``needed`` block, all else is allowed. Rules and terms are parameters of bounded size (:func:`vocabulary_of` reads
    terms from a table) and travel with the code.

    A null url, or one without ``://``, has an empty host and path and no rule; a null one holds no term and is allowed.
    Repeated rows are judged each for themselves. Other columns are not read. An empty table gives none.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    parts = parts.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("fit"))
    parts = parts.select("page_id", "url", "host", "path", "fit.rule", "fit.verdict")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(vocabulary)
        for batch in batches:
            counts = [hits(url or "", automaton) for url in batch.column("url").to_pylist()]
            verdicts = [
                ruled or ("block" if strict or weight >= vocabulary.needed else "allow")
                for ruled, (strict, _, weight) in zip(batch.column("verdict").to_pylist(), counts, strict=True)
            ]
            columns = {name: batch.column(name) for name in ("page_id", "host", "path", "rule")}
            columns["page_id"] = columns["page_id"].cast(pa.int64())
            columns["verdict"] = pa.array(verdicts, pa.string())
            for i, name in enumerate(("strict_hits", "soft_hits", "soft_weight")):
                columns[name] = pa.array([c[i] for c in counts], pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    return parts.mapInArrow(run, SCHEMA)


def judge_sql(rules: Sequence[Rule] = RULES, vocabulary: Vocabulary = VOCABULARY) -> str:
    """DuckDB SQL for the rows of ``judge_urls`` over ``pages``."""
    fits = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}|{r.verdict}'"
        for r in sorted(rules, key=lambda rule: len(rule.name), reverse=True)
    )

    def found(term: str) -> str:
        return f"regexp_matches(lowered, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')::BIGINT"

    strict = " + ".join(map(found, vocabulary.strict))
    soft = " + ".join(f"{weight} * {found(term)}" for term, weight in vocabulary.soft)
    return f"""
    WITH rests AS (
      SELECT page_id, coalesce(url, '') AS url,
        CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest
      FROM pages),
    parts AS (
      SELECT page_id, translate(url, '{UPPER}', '{LOWER}') AS lowered,
        translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
      FROM rests),
    judged AS (SELECT *, CASE {fits} END AS fit, {strict} AS strict_terms, {soft} AS soft_weight FROM parts)
    SELECT page_id, host, path, split_part(fit, '|', 1) AS rule,
      coalesce(split_part(fit, '|', 2),
        CASE WHEN strict_terms > 0 OR soft_weight >= {vocabulary.needed} THEN 'block' ELSE 'allow' END) AS verdict
    FROM judged"""
