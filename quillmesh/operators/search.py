"""Ranked text search, synonym expansion and re-ranking, and search by type."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
WORD = r"[\p{L}\p{N}]+"
MIN_WEIGHT, MOST_TERMS = 0.3, 15
TERM_BOOST = 0.1


def postings(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """key, token, tf, dl: the inverted index of a text."""
    tokens = rows.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)).alias("token"))
    counted = tokens.groupBy(key, "token").agg(F.count("*").alias("tf"))
    return counted.withColumn("dl", F.sum("tf").over(Window.partitionBy(key)))


def bm25(rows: DataFrame, key: str, text: Column, prefixes: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """key, score of rows with a token that begins with some prefix; a prefix counts as one phrase.

    One pass counts the phrases in each row, so the text is tokenized once and only rows that match are shuffled.
    """
    tokens = F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)
    n_of = lambda p: F.size(F.filter("tokens", lambda t: t.startswith(p.lower()))).cast("long")
    counted = rows.select(key, tokens.alias("tokens")).select(key, F.size("tokens").cast("long").alias("dl"), *[n_of(p).alias(f"tf{i}") for i, p in enumerate(prefixes)])
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(prefixes))])
    score = F.lit(0.0)
    for i, p in enumerate(prefixes):
        idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)))
        tf = F.col(f"tf{i}")
        part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
        score = score + F.when(tf > 0, part * (weights or {}).get(p, 1.0)).otherwise(0.0)
    hit = F.greatest(*[F.col(f"tf{i}") for i in range(len(prefixes))], F.lit(0)) > 0
    return counted.filter(hit).join(F.broadcast(stats)).select(key, score.alias("score"))  # stats: one row


def parse_match(query: str) -> list[list[tuple[tuple[str, ...], bool]]]:
    """A full-text query as alternatives (OR) of phrases that must all occur; a phrase is its words, and whether the last is a prefix.

    Without OR, a star or quotes the last word is a prefix.
    """
    plain = not re.search(r"\sOR\s|[*\"]", query, re.I)
    out: list[list[tuple[tuple[str, ...], bool]]] = [[]]
    for m in re.finditer(r'"([^"]*)"?(\*?)|(\S+)', query + ("*" if plain else "")):
        if m[3] and m[3].upper() == "OR":
            out.append([])
            continue
        text, star = (m[3].rstrip("*"), m[3].endswith("*")) if m[3] else (m[1], bool(m[2]))
        words = tuple(re.findall(r"[^\W_]+", text.lower()))
        if words:
            out[-1].append((words, star))
    return [group for group in out if group]


def _occurrences(tokens: Column, phrase: tuple[tuple[str, ...], bool]) -> Column:
    words, prefix = phrase
    last = lambda t: t.startswith(words[-1]) if prefix else t == words[-1]
    if len(words) == 1:
        return F.size(F.filter(tokens, last))

    def here(t: Column, i: Column) -> Column:
        ok = last(F.try_element_at(tokens, i + len(words)))
        for k, w in enumerate(words[:-1]):
            ok = ok & (F.try_element_at(tokens, i + k + 1) == w)
        return F.coalesce(ok, F.lit(False))

    return F.size(F.filter(tokens, here))


def match(rows: DataFrame, key: str, columns: dict[str, float], query: str) -> DataFrame:
    """key, score: rows that a full-text query matches in any of the columns, by BM25 with the columns' weights.

    To scope a search to some columns, give only these.
    """
    groups = parse_match(query)
    phrases = list(dict.fromkeys(p for g in groups for p in g))
    tokens = rows.select(key, *[F.regexp_extract_all(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(WORD), 0).alias(f"_t{i}") for i, c in enumerate(columns)])
    length = sum((F.size(f"_t{i}") for i in range(len(columns))), F.lit(0)).cast("long")
    hits = [[_occurrences(F.col(f"_t{i}"), p) for i in range(len(columns))] for p in phrases]
    counted = tokens.select(
        key, length.alias("_dl"), *[sum(h, F.lit(0)).alias(f"_n{j}") for j, h in enumerate(hits)],
        *[sum((n * float(w) for n, w in zip(h, columns.values(), strict=True)), F.lit(0.0)).alias(f"_f{j}") for j, h in enumerate(hits)],
    )
    stats = counted.agg(F.count("*").alias("_rows"), F.avg("_dl").alias("_mean"), *[F.sum((F.col(f"_n{j}") > 0).cast("long")).alias(f"_df{j}") for j in range(len(phrases))])
    score = F.lit(0.0)
    for j in range(len(phrases)):
        idf = F.greatest(F.lit(1e-6), F.log((F.col("_rows") - F.col(f"_df{j}") + 0.5) / (F.col(f"_df{j}") + 0.5)))
        f = F.col(f"_f{j}")
        score = score + F.when(F.col(f"_n{j}") > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_dl") / F.col("_mean")))).otherwise(0.0)
    every = lambda g: F.forall(F.array(*[F.col(f"_n{phrases.index(p)}") for p in g]), lambda n: n > 0)
    hit = F.greatest(*[every(g) for g in groups], F.lit(False)) if groups else F.lit(False)
    return counted.filter(hit).join(F.broadcast(stats)).select(key, score.alias("score"))  # stats: one row


def by_name(rows: DataFrame, key: str, columns: dict[str, float], query: str, terms: list[tuple[str, float, str]], limit: int = 20, hits: DataFrame | None = None) -> DataFrame:
    """A search's best rows, more than asked for, scored anew by synonyms and cut to the limit (R16). rows: key, name, signature.

    hits: key and score of what an inverted index found, of which rows are kept; else the rows themselves are searched.
    """
    found = match(rows, key, columns, query) if hits is None else hits.join(rows.select(key), key, "left_semi")
    some = found.orderBy(F.desc(F.round("score", 9)), key).limit(over_fetch(limit))
    return rerank(some.join(rows, key), terms).orderBy(F.desc(F.round("combined", 9)), key).limit(limit)


def over_fetch(limit: int) -> int:
    """How many hits are scored anew for so many rows of an answer."""
    return max(2 * limit, 50)


def query_terms(query: str) -> list[str]:
    """Lower case first, then words of two letters and more."""
    return [t for t in query.lower().replace("_", " ").replace("-", " ").split() if len(t) > 1]


def expand_terms(terms: DataFrame, thesaurus: DataFrame, least: float = MIN_WEIGHT, most: int = MOST_TERMS) -> DataFrame:
    """query, term, weight, source: the terms themselves, canonical terms, and their other synonyms.

    A term that is a synonym leads to the canonical term at 0.9 of its weight, and on to siblings at the product of both weights.
    """
    t = thesaurus.filter(F.col("weight") >= least)
    own = terms.select("query", F.col("word").alias("term"), F.lit(1.0).alias("weight"), F.lit("original").alias("source"))
    as_canonical = terms.join(F.broadcast(t), F.col("word") == F.col("canonical")).select("query", "term", "weight", F.lit("synonym").alias("source"))
    hit = terms.join(F.broadcast(t.filter("bidirectional")), F.col("word") == F.col("term")).select("query", "word", F.col("canonical").alias("c"), F.col("weight").alias("w"))
    up = hit.select("query", F.col("c").alias("term"), (F.col("w") * 0.9).alias("weight"), F.lit("canonical").alias("source"))
    across = hit.join(F.broadcast(t), F.col("c") == F.col("canonical")).filter("term <> word").select("query", "term", (F.col("w") * F.col("weight")).alias("weight"), F.lit("synonym").alias("source"))
    every = own.unionByName(as_canonical).unionByName(up).unionByName(across)
    best = every.groupBy("query", "term").agg(F.max_by("source", F.struct("weight", "source")).alias("source"), F.max("weight").alias("weight"))
    w = Window.partitionBy("query").orderBy(F.desc(F.round("weight", 9)), "term")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def synonym_score(name: Column, signature: Column, terms: list[tuple[str, float, str]]) -> Column:
    """How many expansion terms a row holds, weighted; capped at 1."""
    hay = F.lower(F.concat_ws(" ", name, signature))
    bonus = {"original": 0.2, "canonical": 0.1}
    found = [F.contains(hay, F.lit(t)) for t, _, _ in terms]
    n = sum((f.cast("int") for f in found), F.lit(0))
    total = sum((F.when(f, w + bonus.get(s, 0.0)).otherwise(0.0) for f, (_, w, s) in zip(found, terms, strict=True)), F.lit(0.0))
    total = F.when(n > 1, total * (1 + TERM_BOOST * (n - 1))).otherwise(total)
    return F.least(F.lit(1.0), total / F.greatest(F.lit(1.0), F.lit(0.5 * len(terms))))


def rerank(rows: DataFrame, terms: list[tuple[str, float, str]], original: str = "score") -> DataFrame:
    """Combined score: 0.6 of the score over the best one, 0.4 of the synonym score."""
    best = rows.agg(F.max(original).alias("_best"))  # one row
    rated = rows.withColumn("synonym_score", synonym_score(F.col("name"), F.col("signature"), terms)).join(F.broadcast(best))
    return rated.withColumn("combined", F.col(original) * 0.6 / F.greatest(F.col("_best"), F.lit(1e-9)) + F.col("synonym_score") * 0.4).drop("_best")


def type_filter(mode: str, wanted: str, base: Column, inner: Column, raw: Column, is_async: Column, include_async: bool = True) -> Column:
    """Exact, base, inner or partial match of a type; an asynchronous function may hold it as its inner type."""
    w = wanted.lower()
    if mode == "exact":
        return F.lower(raw) == w
    if mode == "base":
        hit = F.lower(base) == w
        return hit | (is_async & F.contains(F.lower(inner), F.lit(w))) if include_async else hit
    if mode == "inner":
        return F.contains(F.lower(inner), F.lit(w))
    return F.contains(F.lower(raw), F.lit(w))


def first_type(wanted: str) -> str:
    """The first word of a type, in lower case, without brackets."""
    words = re.sub(r"[<>\[\]]", " ", wanted.lower()).split()
    return words[0] if words else wanted.lower()


def by_param_type(types: DataFrame, params: DataFrame, wanted: str, mode: str = "base", name: str | None = None, language: str | None = None) -> DataFrame:
    """Parameters of a type with the symbol they belong to, in all four modes (R5, J2). types, params: as type_tables gives them."""
    base, has = first_type(wanted), lambda c: F.contains(F.coalesce(F.lower(c), F.lit("")), F.lit(first_type(wanted)))
    hit = {"exact": F.col("normalized") == wanted, "base": F.col("base") == base, "inner": has("inner"), "partial": has("base") | has("inner") | has("normalized")}[mode]
    hit = hit if name is None else hit & (F.col("param_name") == name)
    kept = types if language is None else types.filter(F.col("language") == language)
    found = params.filter(hit).select("symbol_id", "param_index", "param_name", F.coalesce("normalized", F.lit("any")).alias("param_type"))
    return found.join(kept.select("symbol_id", "symbol_name", "file_path"), "symbol_id")


def by_types(types: DataFrame, params: DataFrame, returns: str | None = None, takes: str | None = None, mode: str = "base", limit: int = 50) -> DataFrame:
    """Symbols by return type, by parameter type, or by both at once, ordered by name; either side gives twice the limit."""
    first = lambda df: df.orderBy("symbol_name", "symbol_id").limit(2 * limit)
    sides = []
    if returns:
        has = lambda c: F.contains(F.coalesce(F.lower(c), F.lit("")), F.lit(first_type(returns)))
        hit = {"exact": F.col("normalized") == returns, "base": F.col("base") == first_type(returns), "inner": has("inner"), "partial": has("base") | has("inner") | has("normalized")}[mode]
        sides.append(first(types.filter(hit).select("symbol_id", "symbol_name")))
    if takes:
        sides.append(first(by_param_type(types, params, takes, mode).select("symbol_id", "symbol_name").distinct()))
    found = sides[0] if len(sides) == 1 else sides[0].join(sides[1].select("symbol_id"), "symbol_id", "left_semi")
    return found.orderBy("symbol_name", "symbol_id").limit(limit)


def fuzzy(rows: DataFrame, key: str, fields: list[str], pattern: str, threshold: float = 0.4) -> DataFrame:
    """key, score: 1 less the share of edits of the best approximate substring of any field (R2).

    Edits cannot touch all of one piece more than there are edits, so a text without any of these pieces is left out by built-in functions.
    What is left is matched by bits: one state word for each number of edits, advanced character by character.
    """
    pattern = pattern.lower()
    most = int(threshold * len(pattern))
    cuts = [i * len(pattern) // (most + 1) for i in range(most + 2)]
    pieces = sorted({pattern[a:b] for a, b in zip(cuts, cuts[1:], strict=False)})
    likely = reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(p)) for f in fields for p in pieces])

    def edits(text: str) -> int | None:
        masks: dict[str, int] = {}
        for i, c in enumerate(pattern):
            masks[c] = masks.get(c, 0) | 1 << i
        goal, states = 1 << len(pattern), [(1 << d + 1) - 1 for d in range(most + 1)]
        best = next((d for d, s in enumerate(states) if s & goal), None)
        for c in text.lower():
            old, m = states[:], masks.get(c, 0)
            states[0] = (old[0] & m) << 1 | 1
            for d in range(1, most + 1):
                states[d] = (old[d] & m) << 1 | old[d - 1] | (old[d - 1] | states[d - 1]) << 1 | 1
            hit = next((d for d, s in enumerate(states) if s & goal), None)
            if hit is not None and (best is None or hit < best):
                best = hit
        return best

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [b[f].fillna("") for f in fields]
            known = {t: edits(t) for column in texts for t in column.unique()}  # a text that stands in several rows is matched once
            found = [min((e for t in row if (e := known[t]) is not None), default=None) for row in zip(*texts, strict=True)]
            out = pd.DataFrame({key: b[key], "score": [None if e is None else 1 - e / max(1, len(pattern)) for e in found]})
            yield out[out["score"].notna()]

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, *fields).filter(likely).mapInPandas(run, f"{key} {kind}, score double")


def synonyms(spark: SparkSession, thesaurus: DataFrame, a: str, b: str) -> DataFrame:
    """Whether two terms share a canonical term."""
    members = thesaurus.select("canonical", "term").union(thesaurus.select("canonical", F.col("canonical"))).distinct()
    both = members.filter(F.col("term").isin(a, b)).groupBy("canonical").agg(F.countDistinct("term").alias("n"))
    return both.agg((F.coalesce(F.max("n"), F.lit(0)) >= (1 if a == b else 2)).alias("are_synonyms"))
