"""Personal data by patterns and a skip-chain conditional random field.

Patterns find e-mail addresses, IP addresses, payment cards and phone numbers. The field labels every token that
could be part of such data: its potentials are features of the token and its neighbours, transitions between adjacent tokens, and agreement
along skip edges that join repeated or similar tokens however far apart. Pattern finds are observed; loopy belief
propagation carries them along the edges, and tokens that then most likely are personal data give added spans. Pattern
spans always stay.

All weights, those of the skip edges included, are learned by pseudo-likelihood from what the patterns find in a bounded sample of
passages (SAMPLE_PASSAGES of PASSAGE code points that hold a digit or an at sign, of all texts, chosen by a hash of id and place).
What repeats in the same form tells nothing about skip edges, so finds are repeated in a form that the patterns miss: labelled as the find where that
stands in the passage, and as nothing in particular where it doesn't. An added span must pass its kind's own test: a card the Luhn sum, an address
four numbers of at most 255, a phone number 9 to 15 digits, an e-mail address its at sign.

Defined results: a null text is the empty text, without spans; null and repeated ids are ordinary rows; an
empty table gives no rows; other columns are ignored or, when redacting, kept. Repeated tokens are joined in a chain, in order, so
edges grow with the text, and memory with the text's tokens that hold a digit or an at sign.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import Scratch, body, tune

KINDS = ("email", "ip", "card", "phone")
SAMPLE_PASSAGES, PASSAGE, EPOCHS, RATE, PENALTY = 2000, 5000, 300, 2.0, 1e-5
ROUNDS, DAMPING, SETTLED, SURE = 200, 0.2, 1e-4, 0.6
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a run of digits that fails at its start fails at each later digit, so starts within runs are skipped
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT, NOT_DIGIT = re.compile("[0-9]"), re.compile("[^0-9]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
EDGE_MARKS = ".,;:!?\"'()[]{}<>|"


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of `[local]+@domain`, sought from each at sign, as no local part holds one."""
    free, at = 0, text.find("@")
    while at >= 0:
        local = text[free:at]
        start = free + len(local.rstrip(LOCAL))
        free = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the pattern finds, by kind, then start."""
    out = [(0, *s) for s in _emails(text)]
    if DIGIT.search(text):
        if text.count(".") > 2:
            out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens that hold a digit or an at sign."""
    out, end = [], 0
    for m in re.finditer(r"[0-9@]", text):
        if m.start() < end:
            continue
        at = m.start()
        while at > end and text[at - 1] not in " \t\n\x0b\x0c\r":
            at -= 1
        end = TOKEN.match(text, at).end()
        out.append((at, end))
    return out


N_FEATURES = 24


def features(token: str, gap_before: bool, gap_after: bool) -> list[int]:
    """Indices of the features that hold."""
    core = token.strip(EDGE_MARKS)
    digits = sum(map(str.isdigit, core))
    dots, dashes = core.count("."), core.count("-")
    on = [0, 1 + min(digits, 3) if digits < 4 else 5 + (digits > 4) + (digits > 7) + (digits > 12) + (digits > 19)]
    on += [i for i, x in (
        (10, "@" in core), (11, digits == len(core)), (12, dots == 3), (13, dots in (1, 2)), (14, dashes > 0), (15, token.startswith("+")), (16, token.startswith("(") and core != token),
        (17, digits * 2 < len(core)), (18, gap_before), (19, gap_after), (20, dots > 3), (21, core.endswith(tuple("0123456789"))), (22, core[:1].isalpha()), (23, "=" in core),
    ) if x]
    return on


def keys(token: str) -> list[str]:
    """Tokens that share one of these are joined by a skip edge."""
    core = token.strip(EDGE_MARKS).lower()
    digits = NOT_DIGIT.sub("", core)
    out = [core] if len(core) > 3 else []
    if len(digits) >= 4:
        out.append(f"#{digits}")
    if "@" in core and len(core.partition("@")[0]) > 2:
        out.append(f"{core.partition('@')[0]}@")
    return out


class Graph:
    """Tokens of several texts, their chain and skip edges, features, and observed labels (-1: not observed)."""

    def __init__(self) -> None:
        self.doc, self.spans, self.on, self.chain, self.skip, self.seen = [], [], [], [], [], []

    def add(self, doc: int, text: str, found: list[tuple[int, int, int]], tokens: list[tuple[int, int]]) -> None:
        base, last, held = len(self.spans), {}, sorted((s, e, k) for k, s, e in found)
        at = 0
        for i, (start, end) in enumerate(tokens):
            token = text[start:end]
            before = i > 0 and start - tokens[i - 1][1] == 1
            after = i + 1 < len(tokens) and tokens[i + 1][0] - end == 1
            self.doc.append(doc)
            self.spans.append((start, end))
            self.on.append(features(token, before, after))
            if before:
                self.chain.append((base + i - 1, base + i))
            while at < len(held) and held[at][1] <= start:
                at += 1
            hit = [k for s, e, k in held[at : at + 4] if s < end and e > start]
            own = keys(token)
            if hit and " " in text[held[at][0] : held[at][1]]:  # a find of several tokens is also joined as a whole
                own.append(f"#{NOT_DIGIT.sub('', text[held[at][0] : held[at][1]])}")
            for j in sorted({last[key] for key in own if key in last}):  # one edge, however many keys are shared
                if not (before and j == base + i - 1):  # those have a chain edge
                    self.skip.append((j, base + i))
            last.update(dict.fromkeys(own, base + i))
            self.seen.append(1 + hit[0] if hit else -1)

    def matrix(self) -> np.ndarray:
        x = np.zeros((len(self.on), N_FEATURES))
        for i, on in enumerate(self.on):
            x[i, on] = 1
        return x

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        return (np.array(e, np.int64).reshape(-1, 2) for e in (self.chain, self.skip))


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def disguises(kind: int, found: str) -> list[str]:
    """The same data in forms that its pattern misses."""
    digits = NOT_DIGIT.sub("", found)
    if kind == 0:
        name, _, domain = found.partition("@")
        return [f"{name}@{domain.partition('.')[0]}"]
    if kind == 1:
        return [found.replace(".", "-")]
    if kind == 2:
        return [".".join(digits[i : i + 4] for i in range(0, len(digits), 4))]
    national = found.partition(" ")[2]
    return [found[1:], national] if len(NOT_DIGIT.sub("", national)) >= 9 else [found[1:]]


def lessons(text: str) -> list[tuple[str, list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Texts with what the patterns find and what else is labelled: text as it is, with a disguised repeat of its first find of each kind, and the disguise without the find."""
    found = base_spans(text)
    out = [(text, found, [])]
    for kind in sorted({k for k, _, _ in found}):
        _, start, end = next(f for f in found if f[0] == kind)
        near = text[max(0, start - 200) : end + 200]
        for hidden in disguises(kind, text[start:end]):
            if not any(k == kind for k, _, _ in base_spans(hidden)):
                at = len(near) + 8
                out.append((f"{near} ...... {hidden}", base_spans(near), [(kind, at, at + len(hidden))]))
                out.append((f"...... {hidden}", [], []))
    return out


def train(texts: list[str]) -> dict:
    """Weights that maximise the pseudo-likelihood of the labels of all lessons, others counting as label 0."""
    g, n = Graph(), 1 + len(KINDS)
    for i, lesson in enumerate(x for text in texts for x in lessons(text)):
        text, found, more = lesson
        g.add(i, text, sorted(found + more), candidates(text))
    unary, chain, skip = np.zeros((N_FEATURES, n)), np.zeros((n, n)), np.zeros(n)
    if not g.on:
        return {"unary": unary, "chain": chain, "skip": skip}
    x, (c, s) = g.matrix(), g.edges()
    y = np.eye(n)[np.maximum(0, np.array(g.seen))]
    around = np.zeros_like(y)
    np.add.at(around, s[:, 0], y[s[:, 1]])
    np.add.at(around, s[:, 1], y[s[:, 0]])
    before, after = np.zeros_like(y), np.zeros_like(y)
    before[c[:, 1]], after[c[:, 0]] = y[c[:, 0]], y[c[:, 1]]
    steps = [np.full_like(w, 1e-8) for w in (unary, chain, skip)]
    for _ in range(EPOCHS):  # steps of each weight shrink with its own gradients
        off = (y - _softmax(x @ unary + before @ chain + after @ chain.T + around * skip)) / len(x)
        slopes = (x.T @ off - PENALTY * unary, before.T @ off + (after.T @ off).T - PENALTY * chain, (around * off).sum(0) - PENALTY * skip)
        for w, slope, held in zip((unary, chain, skip), slopes, steps, strict=True):
            held += slope * slope
            w += 0.1 * RATE * slope / np.sqrt(held)
        np.maximum(skip, 0, out=skip)  # the edges carry agreement only
        skip[0] = 0.0  # and never spread label 0 over what the features tell
    return {"unary": unary, "chain": chain, "skip": skip}


def marginals(g: Graph, model: dict) -> np.ndarray:
    """Beliefs after damped message passing along all edges until no message changes by over SETTLED, in at most ROUNDS rounds."""
    n = 1 + len(KINDS)
    c, s = g.edges()
    own = g.matrix() @ model["unary"]
    seen = np.array(g.seen)
    own[seen >= 0] += 30 * np.eye(n)[seen[seen >= 0]]
    agree = np.diag(model["skip"])
    to = np.concatenate([c[:, 1], c[:, 0], s[:, 1], s[:, 0]])
    source = np.concatenate([c[:, 0], c[:, 1], s[:, 0], s[:, 1]])
    back = np.concatenate([len(c) + np.arange(len(c)), np.arange(len(c)), 2 * len(c) + len(s) + np.arange(len(s)), 2 * len(c) + np.arange(len(s))])
    pair = np.concatenate([np.broadcast_to(t, (k, n, n)) for t, k in ((model["chain"], len(c)), (model["chain"].T, len(c)), (agree, len(s)), (agree, len(s)))])
    message = np.zeros((len(to), n))
    for _ in range(ROUNDS if len(to) else 0):
        belief = own.copy()
        np.add.at(belief, to, message)
        out = (belief[source] - message[back])[:, :, None] + pair
        high = out.max(1)
        new = high + np.log(np.exp(out - high[:, None, :]).sum(1))
        new = DAMPING * message + (1 - DAMPING) * (new - new.max(1, keepdims=True))
        moved, message = np.abs(new - message).max(), new
        if moved < SETTLED:
            break
    belief = own
    np.add.at(belief, to, message)
    return _softmax(belief)


def _covered(tokens: list[tuple[int, int]], found: list[tuple[int, int, int]]) -> bool:
    """Whether every token overlaps a find."""
    held, at = sorted((s, e) for _, s, e in found), 0
    for start, end in tokens:
        while at < len(held) and held[at][1] <= start:
            at += 1
        if at == len(held) or held[at][0] >= end:
            return False
    return True


def passes(kind: int, found: str) -> bool:
    """Whether an added span could be what it is taken for."""
    digits = NOT_DIGIT.sub("", found)
    if kind == 0:
        return "@" in found[1:-1]
    if kind == 1:
        numbers = NOT_DIGIT.sub(" ", found).split()
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    own = text[start:end]
    return start + len(own) - len(own.lstrip(EDGE_MARKS)), end - len(own) + len(own.rstrip(EDGE_MARKS))


def _within(kind: int, text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of neighbouring tokens, the longest runs that pass, from the left; none of over 19 tokens can."""
    out, i = [], 0
    while i < len(spans):
        for j in range(min(len(spans), i + 19), i, -1):
            start, end = _trim(text, spans[i][0], spans[j - 1][1])
            if start < end and passes(kind, text[start:end]):
                out.append((start, end))
                i = j
                break
        else:
            i += 1
    return out


def find(texts: list[str], model: dict) -> list[list[tuple[int, int, int, bool]]]:
    """(kind, start, end, by pattern) of every text, by kind, then start."""
    g, out = Graph(), []
    for i, text in enumerate(texts):
        found = base_spans(text)
        out.append([(*f, True) for f in found])
        if "@" in text or DIGIT.search(text):
            tokens = candidates(text)
            if not _covered(tokens, found):  # else no token is left to decide
                g.add(i, text, found, tokens)
    if g.on:
        belief = marginals(g, model)
        label = np.where(belief.max(1) >= SURE, belief.argmax(1), 0)
        runs: list[list] = []
        for i in np.flatnonzero((label > 0) & (np.array(g.seen) < 0)).tolist():
            here = (g.doc[i], int(label[i]) - 1)
            if runs and runs[-1][0] == here and runs[-1][2] == i - 1 and g.spans[i][0] - runs[-1][1][-1][1] == 1:
                runs[-1][1].append(g.spans[i])
                runs[-1][2] = i
            else:
                runs.append([here, [g.spans[i]], i])
        touched = set()
        for (doc, kind), spans, _ in runs:
            for start, end in _within(kind, texts[doc], spans):
                out[doc].append((kind, start, end, False))
                touched.add(doc)
        for doc in touched:
            out[doc].sort()
    return out


def _passages(text: str) -> Iterator[tuple[int, str]]:
    """Number and text of the passages that hold a digit or an at sign."""
    for at in range(0, len(text), PASSAGE):
        part = text[at : at + PASSAGE]
        if "@" in part or DIGIT.search(part):
            yield at // PASSAGE, part


def fit(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE_PASSAGES, doc_id: str = "doc_id", text: str = "text") -> dict:
    """The weights. First a light table of hashes picks the sample, then only its passages are fetched."""
    tune(spark)
    scratch = Scratch(spark, "pii")
    some = docs.select(F.xxhash64(F.col(doc_id), F.lit(7)).alias("h"), body(text).alias("text")).filter(F.col("text").rlike("[0-9@]"))

    def passages(most: int | None):
        from xxhash import xxh64_intdigest

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for h, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    for k, part in _passages(t.as_py()):
                        own = (h & (1 << 64) - 1) ^ xxh64_intdigest(str(k))  # even over all hashes
                        own -= own >> 63 << 64
                        if most is None:
                            rows.append((own, None))
                        elif own <= most:
                            rows.append((own, part))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["h", "part"])

        return some.mapInArrow(run, "h long, part string")

    marks = scratch.write(passages(None).select("h"), "marks")
    n = marks.count()
    if not n:
        return train([])
    # hashes are even, so those below this bound are a few times the sample
    share = min(1.0, 4 * sample / n)
    low = marks.filter(F.col("h") <= int(-(1 << 63) + share * ((1 << 64) - 1))) if share < 1 else marks
    last = low.orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    rows = passages(last).orderBy("h", F.xxhash64("part")).limit(sample).collect()  # at most `sample` passages of PASSAGE code points
    return train([r["part"] for r in rows])


def spans(spark: SparkSession, docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans: array of kind, start, end (code points, end exclusive), by_pattern."""
    tune(spark)
    shared = spark.sparkContext.broadcast(model)
    found = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("by_pattern", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "by_pattern": p} for k, s, e, p in r] for r in find(b.column(1).to_pylist(), shared.value)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, found)], names=["doc_id", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), body(text).alias("text")).mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,by_pattern:boolean>>")


def redact_text(text: str, found: list[tuple[int, int, int, bool]]) -> str:
    """Each run of overlapping spans becomes the name of its first kind in brackets."""
    out, at, until = [], 0, -1
    for start, end, kind in sorted((s, e, k) for k, s, e, _ in found):
        if start < until:
            at = until = max(until, end)
            continue
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = until = end
    return "".join([*out, text[at:]])


def redact(spark: SparkSession, docs: DataFrame, model: dict, text: str = "text", length: str | None = None) -> DataFrame:
    """docs with personal data replaced in the text; length: the column that holds the text's code points."""
    tune(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text)
            held = b.column(at).to_pylist()
            clean = [None if t is None else redact_text(t, f) if f else t for t, f in zip(held, find([t or "" for t in held], shared.value), strict=True)]
            cols = list(b.columns)
            cols[at] = pa.array(clean, b.schema.field(at).type)
            if length and (k := b.schema.get_field_index(length)) >= 0:
                cols[k] = pa.array([n if c == t else len(c) for n, t, c in zip(cols[k].to_pylist(), held, clean, strict=True)], b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
