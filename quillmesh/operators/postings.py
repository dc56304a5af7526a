"""The inverted index at rest: postings by term and impact, a dictionary with bounds, and searches that read only what they ask for.

A posting is a term of a row: how often and where it stands in each column, and how long the row's columns are. Postings lie in order of
term and of level, a measure of their impact, so that a scan for some terms, or for the upper levels of a term, skips the other row
groups. The dictionary has for each term and level the number of postings and bounds of what they can score. Lengths are summed by file.
All three are replaced by file like the rows they come from. Ids are unique; nulls are empty texts.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.search import B, K1, WORD, parse_match

POSTINGS = "term string, level int, id string, file_path string, tf array<int>, lens array<int>, positions array<array<int>>"
TERMS = "term string, level int, n bigint, most array<int>, least array<int>"
LENGTHS = "file_path string, n bigint, lens array<bigint>"
#: Levels of impact, and the length of a row in tokens at which they are measured. Both bear on how much is skipped, never on what is found.
LEVELS, NOMINAL = 16, 16.0
EPSILON = 1e-9

Phrase = tuple[tuple[str, ...], bool]


def _tokens(columns: list[str]) -> Column:
    return F.array(*[F.regexp_extract_all(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(WORD), 0) for c in columns])


def build(rows: DataFrame, key: str, columns: list[str], owner: str = "file_path") -> DataFrame:
    """Postings of the rows' columns."""
    worded = rows.select(F.col(key).cast("string").alias("id"), F.col(owner).alias("file_path"), _tokens(columns).alias("t"))
    placed = worded.select("id", "file_path", F.transform("t", F.size).alias("lens"), F.posexplode("t").alias("c", "words")).select("id", "file_path", "lens", "c", F.posexplode("words").alias("p", "term"))
    found = placed.groupBy("id", "file_path", "lens", "term").agg(F.sort_array(F.collect_list(F.struct("c", "p"))).alias("at"))
    of = lambda i: F.transform(F.filter("at", lambda x: x["c"] == i), lambda x: x["p"])
    found = found.select("term", "id", "file_path", "lens", F.array(*[of(i) for i in range(len(columns))]).alias("positions"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y).cast("double")
    tf = F.transform("positions", F.size)
    level = F.floor(LEVELS * total(tf) / (total(tf) + K1 * (1 - B + B * total("lens") / NOMINAL))).cast("int")
    return found.select("term", level.alias("level"), "id", "file_path", tf.alias("tf"), "lens", "positions")


def laid_out(postings: DataFrame) -> DataFrame:
    """In the order they are stored in; a hot term is spread over files by level and id."""
    return postings.repartitionByRange("term", F.desc("level"), "id").sortWithinPartitions("term", F.desc("level"), "id")


def dictionary(postings: DataFrame, width: int) -> DataFrame:
    """TERMS: for each term and level the number of postings, the most occurrences and the least length in each column."""
    each = lambda f, c: F.array(*[f(F.col(c)[i]) for i in range(width)])
    return postings.groupBy("term", "level").agg(F.count("*").alias("n"), each(F.max, "tf").alias("most"), each(F.min, "lens").alias("least"))


def lengths(rows: DataFrame, columns: list[str], owner: str = "file_path") -> DataFrame:
    """LENGTHS: rows and tokens of each column, by file."""
    sized = rows.select(F.col(owner).alias("file_path"), F.transform(_tokens(columns), F.size).alias("s"))
    return sized.groupBy("file_path").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(len(columns))]).alias("lens"))


def _is(phrase: Phrase, k: int) -> Column:
    words, prefix = phrase
    return F.col("term").startswith(words[k]) if prefix and k == len(words) - 1 else F.col("term") == words[k]


def wanted(phrases: list[Phrase]) -> Column:
    """The terms that a search reads: equalities and prefixes, which the scan takes over."""
    return reduce(lambda a, b: a | b, [_is(p, k) for p in phrases for k in range(len(p[0]))], F.lit(False))


def _weighted(per_column: list[Column], weights: list[float | None], plain: bool) -> Column:
    return sum((c if plain else c * float(w) for c, w in zip(per_column, weights, strict=True) if w is not None), F.lit(0 if plain else 0.0))


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def _counted(postings: DataFrame, phrases: list[Phrase], weights: list[float | None]) -> DataFrame:
    """id, dl, and for each phrase n (occurrences) and f (weighted ones); phrases of several words meet by their places."""
    width, aggs, out = len(weights), [], []
    for j, phrase in enumerate(phrases):
        if len(phrase[0]) == 1:
            tf = [F.col("tf")[c] for c in range(width)]
            aggs += [F.sum(F.when(_is(phrase, 0), _weighted(tf, weights, plain)).otherwise(0)).alias(f"{name}{j}") for name, plain in (("n", True), ("f", False))]
            out += [F.col(f"n{j}"), F.col(f"f{j}")]
            continue
        meets = []
        for c in range(width):
            starts = []
            for k in range(len(phrase[0])):
                aggs.append(F.flatten(F.collect_list(F.when(_is(phrase, k), _shifted(F.col("positions")[c], k)))).alias(f"p{j}_{c}_{k}"))
                starts.append(F.col(f"p{j}_{c}_{k}"))
            meets.append(F.size(reduce(F.array_intersect, starts)))
        out += [_weighted(meets, weights, plain).alias(f"{name}{j}") for name, plain in (("n", True), ("f", False))]
    length = _weighted([F.col("lens")[c] for c in range(width)], weights, True)
    return postings.filter(wanted(phrases)).groupBy("id").agg(F.first(length).cast("long").alias("dl"), *aggs).select("id", "dl", *out)


def _idf(n: Column | float, df: Column | float, log, most) -> Column | float:
    return most(log((n - df + 0.5) / (df + 0.5)))


def _part(idf, f, dl, mean):
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / mean))


def whole(totals: DataFrame, weights: list[float | None]) -> DataFrame:
    """rows and mean: how many rows there are, and their mean length in the columns that count; one row."""
    length = _weighted([F.sum(F.col("lens")[c]) for c in range(len(weights))], weights, True)
    return totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), (length / F.sum("n")).alias("mean"))


def search(postings: DataFrame, totals: DataFrame, weights: list[float | None], query: str) -> DataFrame:
    """id, score: rows that a full-text query matches, by BM25. weights: of each column, none for columns out of scope.

    Only postings of the query's terms are read, and their places only for phrases of several words.
    """
    groups = parse_match(query)
    phrases = list(dict.fromkeys(p for g in groups for p in g))
    counted = _counted(postings, phrases, weights)
    hits = counted.agg(*[F.count_if(F.col(f"n{j}") > 0).alias(f"df{j}") for j in range(len(phrases))], F.lit(0).alias("_"))
    stats = whole(totals, weights).join(F.broadcast(hits))  # one row each
    score = F.lit(0.0)
    for j in range(len(phrases)):
        idf = _idf(F.col("rows"), F.col(f"df{j}"), F.log, lambda x: F.greatest(F.lit(1e-6), x))
        score = score + F.when(F.col(f"n{j}") > 0, _part(idf, F.col(f"f{j}"), F.col("dl"), F.col("mean"))).otherwise(0.0)
    every = lambda g: reduce(lambda a, b: a & b, [F.col(f"n{phrases.index(p)}") > 0 for p in g])
    hit = reduce(lambda a, b: a | b, [every(g) for g in groups], F.lit(False))
    return counted.filter(hit).join(F.broadcast(stats)).select("id", score.alias("score"))  # stats: one row


def reaching(own: DataFrame, terms: DataFrame, totals: DataFrame, weights: list[float | None], words: list[str], k: int, exact_counts: bool = True) -> tuple[dict[str, list[int]], dict[str, list[int]], DataFrame]:
    """For each word the levels that may hold one of the k best, all its levels, and what each posting of the words scores.

    A first look at the upper levels gives a score that k rows reach; a level is out of reach where its bound, with the best of all other
    words, stays below.
    """
    width, inside = len(weights), [(c, w) for c, w in enumerate(weights) if w is not None]
    rows, mean = whole(totals, weights).first()
    spread = terms.filter(F.col("term").isin(words)).groupBy("term", "level").agg(F.sum("n").alias("n"), *[F.max(F.col("most")[c]).alias(f"m{c}") for c in range(width)], *[F.min(F.col("least")[c]).alias(f"l{c}") for c in range(width)]).collect()  # LEVELS + 1 rows of a word at most
    if exact_counts and None not in weights:
        count = {w: sum(r["n"] for r in spread if r["term"] == w) for w in words}
    else:
        held = own.filter(F.greatest(*[F.col("tf")[c] for c, _ in inside], F.lit(0)) > 0)
        count = {r["term"]: r["n"] for r in held.groupBy("term").agg(F.count("*").alias("n")).collect()}  # a row for each word
    idf = {w: _idf(rows, count.get(w, 0), math.log, lambda x: max(1e-6, x)) for w in words}
    sizes, bound = {}, {w: {} for w in words}
    for r in spread:
        f = sum(r[f"m{c}"] * w for c, w in inside)
        bound[r["term"]][r["level"]] = _part(idf[r["term"]], f, sum(r[f"l{c}"] for c, _ in inside), mean) if f else 0.0
        sizes[r["term"], r["level"]] = r["n"]
    f = _weighted([F.col("tf")[c] for c in range(width)], weights, False)
    part = _part(F.create_map(*[F.lit(x) for kv in idf.items() for x in kv])[F.col("term")], f, _weighted([F.col("lens")[c] for c in range(width)], weights, True), F.lit(mean))
    scored = own.filter(f > 0).withColumn("part", part)
    upper: dict[str, list[int]] = {}
    for w in words:
        seen, upper[w] = 0, []
        for level in sorted(bound[w], key=lambda x: -bound[w][x]):
            if seen < k:
                upper[w].append(level)
                seen += sizes[w, level]
    reached = [r["score"] for r in _top(scored.filter(_within(upper)).groupBy("id").agg(F.sum("part").alias("score")), k).collect()]  # k rows at most
    least = reached[-1] if len(reached) == k else 0.0
    peak = {w: max(bound[w].values(), default=0.0) for w in words}
    kept = {w: [level for level, most in bound[w].items() if most + sum(peak.values()) - peak[w] >= least - EPSILON] for w in words}
    return kept, {w: list(bound[w]) for w in words}, scored


def _top(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc(F.round("score", 9)), "id").limit(k)


def _within(levels: dict[str, list[int]]) -> Column:
    return reduce(lambda a, b: a | b, [(F.col("term") == w) & F.col("level").isin(ls) for w, ls in levels.items() if ls], F.lit(False))


def best(postings: DataFrame, terms: DataFrame, totals: DataFrame, weights: list[float | None], query: str, k: int, exact_counts: bool = True) -> DataFrame:
    """The k best rows of search, ties by id. Alternatives of whole words skip the levels that are out of reach.

    exact_counts: the dictionary counts no posting that is gone. Levels within reach name the candidates, which are scored over all their words.
    """
    groups = parse_match(query)
    if not groups or any(len(g) > 1 or len(g[0][0]) > 1 or g[0][1] for g in groups):
        return _top(search(postings, totals, weights, query), k)
    words = list(dict.fromkeys(g[0][0][0] for g in groups))
    kept, every, scored = reaching(postings.filter(F.col("term").isin(words)), terms, totals, weights, words, k, exact_counts)
    candidates = scored.filter(_within(kept))
    if len(words) > 1 and any(len(kept[w]) < len(every[w]) for w in words):
        candidates = scored.join(candidates.select("id").distinct(), "id", "left_semi")
    return _top(candidates.groupBy("id").agg(F.sum("part").alias("score")), k)
