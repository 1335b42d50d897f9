"""Full-text search: a postings table, web-style queries, cover-density rank, and headlines."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"(?U)\w+"
#: Weights of title and body words.
TITLE_WEIGHT, BODY_WEIGHT = 1.0, 0.4


@dataclass(frozen=True)
class Term:
    words: tuple[str, ...]
    negated: bool = False


@dataclass
class Query:
    """Alternatives, each a conjunction of terms (single words or phrases)."""

    alternatives: list[list[Term]] = field(default_factory=list)

    def words(self) -> list[str]:
        return sorted({w for a in self.alternatives for t in a for w in t.words})


def parse(text: str) -> Query:
    """Web-style: words are required, "..." is a phrase, `or` separates alternatives, - negates."""
    query, own = Query(), []
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if word.lower() == "or" and not minus:
            if own:
                query.alternatives.append(own)
            own = []
            continue
        words = tuple(re.findall(r"\w+", (phrase or word).lower()))
        if words:
            own.append(Term(words, bool(minus)))
    if own:
        query.alternatives.append(own)
    return query


def documents(eligible: DataFrame) -> DataFrame:
    """A search document an eligible article; the hash says when to index it again."""
    rows = eligible.select("article_id", "source_id", "language_code", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("body"), "time_s")
    return rows.withColumn("document_hash", F.sha2(F.to_json(F.struct(*sorted(c for c in rows.columns if c != "article_id"))), 256))


def postings(docs: DataFrame) -> DataFrame:
    """(lexeme, article_id, positions, title_words): places of each word, title first.  Kept
    bucketed or partitioned by lexeme, a query reads its own words only."""
    split = lambda c: F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))
    rows = docs.select("article_id", split(F.col("title")).alias("t"), split(F.col("body")).alias("b"))
    words = rows.select("article_id", F.size("t").alias("title_words"), F.posexplode(F.concat("t", "b")).alias("pos", "lexeme"))
    return words.groupBy("lexeme", "article_id").agg(F.array_sort(F.collect_list(F.col("pos") + 1)).alias("positions"), F.first("title_words").alias("title_words"))


def _holds(term: Term) -> Column:
    first = F.try_element_at("at", F.lit(term.words[0]))
    if len(term.words) == 1:
        found = first.isNotNull()
    else:

        def follows(p: Column) -> Column:
            ok = F.lit(True)
            for k, w in enumerate(term.words[1:], 1):
                ok = ok & F.coalesce(F.array_contains(F.try_element_at("at", F.lit(w)), p + k), F.lit(False))
            return ok

        found = F.coalesce(F.exists(first, follows), F.lit(False))
    return ~found if term.negated else found


def covers(places: dict[str, list[int]], needed: list[str]) -> list[list[tuple[int, str]]]:
    """Minimal runs of word places that hold every needed word, from left to right."""
    entries = sorted((p, w) for w in needed for p in places.get(w, ()))
    out, begin = [], 0
    while True:
        seen: set[str] = set()
        end = next((k for k in range(begin, len(entries)) if seen.add(entries[k][1]) or len(seen) == len(needed)), None)
        if end is None:
            return out
        left: set[str] = set()
        start = next(k for k in range(end, begin - 1, -1) if left.add(entries[k][1]) or len(left) == len(needed))
        out.append(entries[start : end + 1])
        begin = start + 1


def cover_density(places: dict[str, list[int]], title_words: int, alternatives: list[list[str]]) -> float:
    """Sum over covers of the harmonic weight of their words, thinned by the words between."""
    total = 0.0
    for needed in alternatives:
        for run in covers(places, needed) if needed else ():
            spread = sum(1 / (TITLE_WEIGHT if p <= title_words else BODY_WEIGHT) for p, _ in run)
            noise = run[-1][0] - run[0][0] - (len(run) - 1)
            total += len(run) / spread / (1 + (noise if noise >= 0 else (len(run) - 1) / 2))
    return total


def search(docs: DataFrame, posted: DataFrame, text: str) -> DataFrame:
    """The documents that match, with rank.  A blank query matches all, rank 0."""
    query = parse(text)
    if not query.alternatives:
        return docs.withColumn("rank", F.lit(0.0))
    own = posted.where(F.col("lexeme").isin(*query.words()))
    hits = own.groupBy("article_id").agg(F.map_from_entries(F.collect_list(F.struct("lexeme", "positions"))).alias("at"), F.first("title_words").alias("title_words"))
    ok = F.lit(False)
    for alternative in query.alternatives:
        both = F.lit(True)
        for term in alternative:
            both = both & _holds(term)
        ok = ok | both
    # without a required word documents that have none of the words match too
    how = "left" if any(all(t.negated for t in a) for a in query.alternatives) else "inner"
    empty = F.create_map().cast("map<string,array<int>>")
    rows = docs.join(hits, "article_id", how).withColumn("at", F.coalesce("at", empty)).where(ok)
    needed = [sorted({w for t in a if not t.negated for w in t.words}) for a in query.alternatives]

    @F.pandas_udf("double")
    def rank(at: pd.Series, title_words: pd.Series) -> pd.Series:
        return pd.Series([cover_density({k: list(v) for k, v in dict(m).items()}, int(n) if n == n and n is not None else 0, needed) for m, n in zip(at, title_words, strict=True)])

    return rows.withColumn("rank", rank("at", "title_words")).drop("at", "title_words")


#: Words of a fragment.
FEWEST, MOST = 15, 35


def best_window(hits: Sequence[tuple[int, str]], words: int, taken: Sequence[tuple[int, int]] = (), fewest: int = FEWEST, most: int = MOST) -> tuple[int, int] | None:
    """The words [begin, end) of the best fragment, none if no match is free: of all runs of at most `most`
    words that begin and end with a match, outside what is taken, the one with the most different matches,
    then the shortest that has them, then the most matches, then the first.  One below `fewest` words
    grows to the right, then to the left, as far as there is room."""
    free = lambda a, b: all(b <= x or a >= y for x, y in taken)
    best: tuple[tuple, int, int] | None = None
    for i, (begin, _) in enumerate(hits):
        seen: set[str] = set()
        for k in range(i, len(hits)):
            end = hits[k][0] + 1
            if end - begin > most or not free(begin, end):
                break
            if hits[k][1] in seen and best is not None and len(seen) < -best[0][0]:
                continue
            seen.add(hits[k][1])
            rank = (-len(seen), end - begin, -(k - i + 1), begin)
            if best is None or rank < best[0]:
                best = (rank, begin, end)
    if best is None:
        return None
    _, begin, end = best
    right = min([words, *(x for x, _ in taken if x >= end)])
    left = max([0, *(y for _, y in taken if y <= begin)])
    end = min(right, max(end, begin + fewest))
    return max(left, min(begin, end - fewest)), end


def fragments(body: str | None, words: Sequence[str], count: int = 1, fewest: int = FEWEST, most: int = MOST) -> str | None:
    """Up to `count` fragments of a text in its order, joined by " ... ", with matches in <mark>; its first
    words where nothing matches."""
    if body is None:
        return None
    listed = body.split()
    wanted = set(words)
    bare = [{w for w in re.findall(r"\w+", x.lower()) if w in wanted} for x in listed]
    hits = [(k, w) for k, ws in enumerate(bare) for w in sorted(ws)]
    taken: list[tuple[int, int]] = []
    while len(taken) < count and (found := best_window(hits, len(listed), taken, fewest, most)):
        taken.append(found)
    marked = [re.sub(r"\w+", lambda m: f"<mark>{m[0]}</mark>" if m[0].lower() in wanted else m[0], x) if bare[k] else x for k, x in enumerate(listed)]
    return " ... ".join(" ".join(marked[a:b]) for a, b in sorted(taken) or [(0, fewest)])


def headline(body: Column, text: str, count: int = 1) -> Column:
    """The best fragments of a body for a query; without words, the first 300 characters."""
    words = parse(text).words()
    if not words:
        return F.substring(body, 1, 300)

    def each(bodies: pd.Series) -> pd.Series:
        return pd.Series([fragments(b, words, count) for b in bodies], dtype=object)

    return F.pandas_udf(each, "string")(body)


def page(rows: DataFrame, sort: str, number: int, size: int) -> DataFrame:
    """One page: relevance, newest or oldest, with ids to break ties, nulls last."""
    order = {"relevance": [F.desc("rank"), F.desc_nulls_last("time_s"), F.col("article_id")], "newest": [F.desc_nulls_last("time_s"), F.col("article_id")], "oldest": [F.asc_nulls_last("time_s"), F.col("article_id")]}[sort]
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)
