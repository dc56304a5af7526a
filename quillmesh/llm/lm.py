"""Language-model scoring by a gated recurrent network in numpy.

Word counts are gathered over all training texts. The MODEL_WORDS most frequent words are dealt to CLASSES classes of equal sums of square
roots of frequency, and CLASSES / GROUPS of them that follow each other make a group; each other word, known or not, belongs to one of RARE rare classes by
its last two bytes, which make one more group. The network predicts the group, the class in it, then the word within its class: by a softmax
for frequent words, by smoothed counts for rare ones. Output biases start at the counts, so training begins at the unigram distribution.

Training runs once on every token of all training texts: a first part alone, then shares of about SHARE_TOKENS tokens, dealt by a hash of id
and text, each from the first part's weights by backpropagation truncated at STEPS tokens, and the shares' weights are averaged, by tokens.
Neither shares nor their order depend on how the input is partitioned. Scoring carries the state from window to window through the whole
text, whatever its length. The HEAD most frequent words go to every task; counts of the rest are joined.

Defined results: a null text is the empty text, which has one token, its end; null and repeated ids are ordinary
rows; without training texts every count is zero; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import Scratch, body, fold, tune

END = b"\n"  # stands for the end of a text; no word holds white space
HEAD, MODEL_WORDS, CLASSES, RARE, HIDDEN = 200_000, 4096, 64, 32, 32
STEPS, TRAIN_LANES, LATER_LANES, LEARN, CLIP = 32, 128, 256, 0.1, 1.0  # later: from trained weights
UPDATES, LEAST_LANES, SHARE_TOKENS = 400, 16, 3_000_000
LANES, WINDOW, TOKENS_AT_ONCE = 128, 64, 1_500_000
TEXT_AT_ONCE, COUNTED_AT_ONCE = 8 << 20, 16 << 20  # bytes
START, SAFE = MODEL_WORDS + RARE, 40.0
GROUPS = 8  # of CLASSES / GROUPS classes each; one more holds the rare classes
RANKS = 12  # so many occurrences of an id in a window are summed side by side


def tokens(text: str) -> list[bytes]:
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, without ends, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, n = lists.flatten().cast(pa.binary()), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at either end leaves an empty piece
    if not full.all():
        words = words.filter(pa.array(full))
        n = np.diff(np.r_[0, np.cumsum(full)][np.r_[0, np.cumsum(n)]])
    return words, n


def gathered(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.Table]:
    """The batches in tables whose texts have about so many bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(column).nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def whole(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % RARE


@cache
def _bucket_table() -> np.ndarray:
    """The buckets of words that end in two bytes, and of one byte after those."""
    return np.array([bucket(bytes(divmod(i, 256))) for i in range(1 << 16)] + [bucket(bytes([i])) for i in range(256)], np.int64)


def buckets(words: pa.Array) -> np.ndarray:
    """bucket of each word; none is empty."""
    if not len(words):
        return np.zeros(0, np.int64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)
    last = data[ends[1:] - 1].astype(np.int64)
    return _bucket_table()[np.where(np.diff(ends) > 1, data[np.maximum(ends[1:] - 2, 0)] * np.int64(256) + last, (1 << 16) + last)]


class Vocabulary:
    """The head words and totals of all training words. rows: (word, count), most frequent first."""

    def __init__(self, rows: list[tuple[bytes, int]], n_tokens: int, n_words: int, rare: dict[int, tuple[int, int]]):
        self.words = pa.array([w for w, _ in rows], pa.binary())
        self.counts = np.array([c for _, c in rows], np.float64)
        self.log_count = np.log10(self.counts + 0.5)
        self.n_tokens, self.n_words = n_tokens, n_words
        self.base_total = np.log10(n_tokens + 0.5 * (n_words + 1))
        self.n_model = min(MODEL_WORDS, len(rows))
        self.buckets = np.array([bucket(w) for w, _ in rows] or [0], np.int64)
        self.net = np.where(np.arange(len(self.buckets)) < self.n_model, np.arange(len(self.buckets)), MODEL_WORDS + self.buckets)
        # all training words of each rare class, less those that the network has itself
        own_n = np.bincount(self.buckets[: self.n_model], self.counts[: self.n_model], RARE) if rows else np.zeros(RARE)
        own_v = np.bincount(self.buckets[: self.n_model], minlength=RARE) if rows else np.zeros(RARE)
        self.rare_n = np.maximum(0, np.array([rare.get(b, (0, 0))[0] for b in range(RARE)]) - own_n)
        self.rare_total = np.log10(self.rare_n + 0.5 * (np.array([rare.get(b, (0, 0))[1] for b in range(RARE)]) - own_v + 1))
        root = np.sqrt(self.counts[: self.n_model])  # classes of equal sums of roots have least to sum over: frequent words stand with few
        share = np.cumsum(root)
        at = np.minimum(CLASSES - 1, ((share - root / 2) / max(1, share[-1] if len(share) else 1) * CLASSES).astype(int))
        self.word_class = at
        self.first = np.searchsorted(at, np.arange(CLASSES + 1))
        # where the softmaxes of groups, classes and words begin among the outputs
        begin = np.r_[0, GROUPS + 1 + np.arange(0, CLASSES + 1, CLASSES // GROUPS), GROUPS + 1 + CLASSES + RARE + self.first[:-1]]
        size = np.diff(begin, append=GROUPS + 1 + CLASSES + RARE + MODEL_WORDS)
        self.softmaxes = begin[size > 0], size[size > 0]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Of all texts, end to end: how many tokens each has, head ids (-1 beyond the head), network ids (rare classes after the words), the words beyond the head, and their texts."""
        words, n = split(texts)
        words = pa.concat_arrays([words, pa.array([END], pa.binary())])
        known = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False)
        text = np.repeat(np.arange(len(n)), n + 1)
        source = np.full(len(text), len(words) - 1)  # an end, unless set below
        source[np.arange(len(words) - 1) + text_of(n)] = np.arange(len(words) - 1)
        head = known[source].astype(np.int64)
        net = self.net[head]  # of the last place, and set below, where the word is beyond the head
        beyond = np.flatnonzero(head < 0)
        tail = words.take(pa.array(source[beyond]))
        net[beyond] = MODEL_WORDS + buckets(tail)
        return n + 1, head, net, tail, text[beyond]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Head ids, network ids and words beyond the head of one text."""
        _, head, net, tail, _ = self.encode_all(pa.array([text]))
        return head, net, tail.to_pylist()


def text_of(n: np.ndarray) -> np.ndarray:
    """The text of each word, if texts have n words each."""
    return np.repeat(np.arange(len(n)), n)


Weights = dict[str, np.ndarray]


def initial(v: Vocabulary, seed: int = 0) -> Weights:
    r = np.random.default_rng(seed)
    h, small = HIDDEN, lambda *s: (r.standard_normal(s) * 0.1).astype(np.float32)
    class_n = np.concatenate([np.bincount(v.word_class, v.counts[: v.n_model], CLASSES) if v.n_model else np.zeros(CLASSES), v.rare_n])
    group_n = np.append(class_n[:CLASSES].reshape(GROUPS, -1).sum(1), v.rare_n.sum())
    class_n[:CLASSES][np.diff(v.first) == 0] = -1  # classes without words
    word_bias = np.zeros(MODEL_WORDS, np.float32)
    word_bias[: v.n_model] = np.log(v.counts[: v.n_model] + 0.5)
    return {
        "x": small(START + 1, 3 * h), "u": small(h, 3 * h) * 3, "b": np.r_[np.ones(h), np.zeros(2 * h)].astype(np.float32),
        "g": np.zeros((h, GROUPS + 1), np.float32), "gb": np.log(group_n + 0.5).astype(np.float32),
        "c": np.zeros((h, CLASSES + RARE), np.float32), "cb": np.where(class_n < 0, -30, np.log(np.maximum(class_n, 0) + 0.5)).astype(np.float32),
        "w": np.zeros((MODEL_WORDS, h), np.float32), "wb": word_bias,
    }


class Lanes:
    """Documents laid end to end in lanes of nearly equal length: inputs, targets, owners by step and lane."""

    def __init__(self, docs: list[np.ndarray], lanes: int):
        n = max(1, min(lanes, len(docs)))
        heap, held = [(0, i) for i in range(n)], [[] for _ in range(n)]
        for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
            size, i = heapq.heappop(heap)
            held[i].append(d)
            heapq.heappush(heap, (size + len(docs[d]), i))
        held.sort(key=lambda ds: -sum(len(docs[d]) for d in ds))
        self.sizes = np.array([sum(len(docs[d]) for d in ds) for ds in held])
        steps = int(self.sizes.max(initial=0))
        self.target, self.input, self.owner = (np.zeros((steps, n), np.int32) for _ in range(3))
        for i, ds in enumerate(held):
            if ds:
                joined = np.concatenate([docs[d] for d in ds])
                self.target[: len(joined), i] = joined
                self.input[: len(joined), i] = np.concatenate([np.r_[START, docs[d][:-1]] for d in ds])
                self.owner[: len(joined), i] = np.repeat(ds, [len(docs[d]) for d in ds])

    def active(self, step: int) -> int:
        return int(np.searchsorted(-self.sizes, -step, side="left"))

    def begins(self) -> list[bool]:
        """Of each step, whether a text begins in a lane."""
        return (self.input == START).any(1).tolist()


def _parts(v: Vocabulary, edges: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
    """For groups, classes and words the softmaxes (i, j, a, b): tokens i to j have the rows a to b of the output layer. edges: of the sorted tokens' classes."""
    per, i, n = CLASSES // GROUPS, edges.tolist(), int(edges[-1])
    classes = [(i[k], i[k + per], GROUPS + 1 + k, GROUPS + 1 + k + per) for k in range(0, CLASSES, per)]
    classes.append((i[CLASSES], n, GROUPS + 1 + CLASSES, GROUPS + 1 + CLASSES + RARE))
    first = (v.first + GROUPS + 1 + CLASSES + RARE).tolist()
    words = [(i[k], i[k + 1], first[k], first[k + 1]) for k in range(CLASSES)]
    return [[(0, n, 0, GROUPS + 1)], *([x for x in some if x[0] < x[1]] for some in (classes, words))]


def _rows(p: Weights, v: Vocabulary) -> np.ndarray:
    """The output layer, a row for each output, its bias in the last column; biases are at most 0 in each softmax."""
    h, g, n = len(p["g"]), len(p["gb"]), len(p["gb"]) + len(p["cb"])
    rows = np.empty((n + len(p["wb"]), h + 1), p["w"].dtype)
    rows[:g, :h], rows[g:n, :h], rows[n:, :h] = p["g"].T, p["c"].T, p["w"]
    bias = np.concatenate([p["gb"], p["cb"], p["wb"]])
    begin, size = v.softmaxes
    rows[:, h] = bias - np.repeat(np.maximum.reduceat(bias, begin), size)
    return rows


def _output(p: Weights, v: Vocabulary, states: np.ndarray, target: np.ndarray, grad: Weights | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probability of each target's group, class and word, and with grad the gradient to the states. states: a column for each target.

    The logits of all softmaxes lie in one array, those of a token side by side, so only products of matrices go part by part.
    """
    rare = target >= MODEL_WORDS
    word = np.where(rare, 0, target)
    cls = np.where(rare, CLASSES + target - MODEL_WORDS, v.word_class[word] if v.n_model else 0)
    order = np.argsort(cls.astype(np.uint8), kind="stable")  # 8 bits sort by radix
    cls, word, n, h = cls[order], word[order], len(cls), len(states)
    own = np.ones((n, h + 1), states.dtype)
    own[:, :h] = np.ascontiguousarray(states.T)[order]
    edges = np.searchsorted(cls, np.arange(CLASSES + 2))
    edges[-1] = n
    levels = _parts(v, edges)
    rows = _rows(p, v)
    # of each level's tokens in turn: how many logits, and which is the target's
    per, n_words = CLASSES // GROUPS, int(edges[CLASSES])
    of = cls[:n_words]
    size = np.concatenate([np.full(n, GROUPS + 1), np.where(cls < CLASSES, per, RARE), np.diff(v.first)[of]])
    at = np.concatenate([np.minimum(cls // per, GROUPS), np.where(cls < CLASSES, cls % per, cls - CLASSES), word[:n_words] - v.first[of]])
    ends = np.cumsum(size)
    first = ends - size
    at += first
    flat = np.empty(int(ends[-1]) if n else 0, states.dtype)
    blocks = []  # of flat, a row for each token
    for base, parts in zip((0, n, 2 * n), levels, strict=True):
        for i, j, a, b in parts:
            block = flat[first[base + i] : ends[base + j - 1]].reshape(j - i, b - a) if i < j else flat[:0].reshape(0, b - a)
            np.matmul(own[i:j], rows[a:b].T, out=block)
            blocks.append((base, i, j, a, b, block))
    if n and not (np.abs(states).max() <= 1.001 and np.abs(rows[:, :h]).sum(1).max() < SAFE):
        flat -= np.repeat(np.maximum.reduceat(flat, first), size)  # else no exponential overflows, or is lost in a whole softmax
    logits = flat[at]
    np.exp(flat, out=flat)
    total = np.add.reduceat(flat, first) if n else flat
    logits -= np.log(total)
    logp = logits[:n] + logits[n : 2 * n]
    logp[:n_words] += logits[2 * n :]
    out = np.empty(n, np.float64)
    out[order] = logp
    if grad is None:
        return out, None
    flat[at] -= total  # total times the gradient of the negative, so states and results are divided by it
    total = (1 / total)[:, None]
    shares = np.concatenate([own, own, own[:n_words]])
    shares *= total
    to_rows, to_states, inner = np.zeros_like(rows), np.empty((len(total), h), states.dtype), np.ascontiguousarray(rows[:, :h])
    for base, i, j, a, b, block in blocks:
        np.matmul(block.T, shares[base + i : base + j], out=to_rows[a:b])
        np.matmul(block, inner[a:b], out=to_states[base + i : base + j])
    to_states *= total
    back = to_states[:n] + to_states[n : 2 * n]
    back[:n_words] += to_states[2 * n :]
    at = 0
    for k in "gcw":
        some = to_rows[at : at + len(grad[k + "b"])]
        grad[k] += some[:, :h] if k == "w" else some[:, :h].T
        grad[k + "b"] += some[:, h]
        at += len(some)
    turned = np.empty_like(back)
    turned[order] = back
    return out, turned.T


def _step(x: np.ndarray, state: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state after one token, a column for each lane, and the inner part of the candidate. x: inputs with biases; becomes the gates and the candidate. u: transposed."""
    h = HIDDEN
    g = u @ state
    gates, m = x[: 2 * h], x[2 * h :]
    gates += g[: 2 * h]
    np.negative(gates, out=gates)
    np.exp(gates, out=gates)  # one over infinity is zero
    gates += 1
    np.reciprocal(gates, out=gates)
    m += gates[h:] * g[2 * h :]
    np.tanh(m, out=m)
    out = state - m
    out *= gates[:h]
    out += m
    return out, g[2 * h :]


def _columns_of(p: Weights, inputs: np.ndarray) -> np.ndarray:
    """steps x gates x lanes: the inputs' rows of x with the biases."""
    return np.ascontiguousarray((p["x"] + p["b"])[inputs].transpose(0, 2, 1))


def log_likelihoods(p: Weights, v: Vocabulary, docs: list[np.ndarray]) -> np.ndarray:
    """log10 probability of the classes, and words of frequent classes, of each whole document."""
    out = np.zeros(len(docs))
    lay = Lanes(docs, LANES)
    steps, lanes = lay.target.shape
    state, u = np.zeros((HIDDEN, lanes), np.float32), np.ascontiguousarray(p["u"].T)
    begins, live = lay.begins(), np.searchsorted(-lay.sizes, -np.arange(steps), side="left").tolist()
    for at in range(0, steps, WINDOW):
        to, n = min(steps, at + WINDOW), live[at]
        x = _columns_of(p, lay.input[at:to, :n])
        whole = live[to - 1] == n
        states = np.empty((to - at, n, HIDDEN), np.float32)
        for t in range(at, to):
            m = live[t]
            own = state[:, :m]
            if begins[t]:
                own[:, lay.input[t, :m] == START] = 0
            own = _step(x[t - at] if m == n else np.ascontiguousarray(x[t - at, :, :m]), own, u)[0]
            if m == lanes:
                state = own
            else:
                state[:, :m] = own
            states[t - at, :m] = own.T
        states, targets, owners = states.reshape(-1, HIDDEN), lay.target[at:to, :n].ravel(), lay.owner[at:to, :n].ravel()
        if not whole:
            places = np.flatnonzero(np.arange(n) < np.array(live[at:to])[:, None])
            states, targets, owners = states[places], targets[places], owners[places]
        out += np.bincount(owners, _output(p, v, states.T, targets)[0], len(docs))
    return out / np.log(10)


def _sums(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in order, and the sum of the rows of each."""
    order = np.argsort(ids.astype(np.uint16), kind="stable")  # 16 bits sort by radix
    ids = ids[order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    counts = np.diff(first, append=len(ids))
    most = np.argsort(-counts, kind="stable")  # ids with most rows first, so those that have another row are always the first ones
    first, counts = first[most], counts[most]
    sums = rows[order[first]]
    for k in range(1, min(RANKS, counts[0])):
        n = int(np.searchsorted(-counts, -k))
        sums[:n] += rows[order[first[:n] + k]]
    for i in range(int(np.searchsorted(-counts, -RANKS))):
        sums[i] += rows[order[first[i] + RANKS : first[i] + counts[i]]].sum(0)
    most = np.argsort(most)
    return ids[first[most]].astype(np.int64), sums[most]


def gradients(p: Weights, v: Vocabulary, inputs: np.ndarray, targets: np.ndarray, live: np.ndarray, state: np.ndarray) -> tuple[float, Weights, np.ndarray, np.ndarray]:
    """Of one window of steps x lanes: log likelihood, gradient of its negative, rows of x that it concerns, and the state after. live: which places hold tokens; state: a column for each lane.

    The gradient of "x" has a row for each input id that occurs, those of the second last result. It stops at the window's first state.
    """
    steps, n = inputs.shape
    h, kind = HIDDEN, p["u"].dtype
    x, start, u = _columns_of(p, inputs), inputs == START, np.ascontiguousarray(p["u"].T)
    before, after, inner = (np.empty((steps, h, n), kind) for _ in range(3))
    begins = start.any(1).tolist()
    for t in range(steps):
        before[t] = state
        if begins[t]:
            before[t][:, start[t]] = 0
        after[t], inner[t] = _step(x[t], before[t], u)  # x holds gates and candidates from here on
        state = after[t]
    grad = {k: np.zeros_like(w) for k, w in p.items() if k not in ("x", "u", "b")}
    states, places = after.transpose(0, 2, 1).reshape(-1, h), np.flatnonzero(live)
    whole = len(places) == steps * n
    logp, off = _output(p, v, (states if whole else states[places]).T, targets.reshape(-1)[places], grad)
    back = off.T if whole else np.zeros((steps * n, h), kind)
    if not whole:
        back[places] = off.T
    back = np.ascontiguousarray(back.reshape(steps, n, h).transpose(0, 2, 1))
    # what the gradient to a state is multiplied by, for gates and candidate, and for what the state before adds to them
    z, r, m = x[:, :h], x[:, h : 2 * h], x[:, 2 * h :]
    to_inner = (1 - z) * (1 - m * m)
    times = np.empty((steps, 3, h, n), kind)
    times[:, 0] = (before - m) * z * (1 - z)
    np.multiply(to_inner, r, out=times[:, 2])
    times[:, 1] = times[:, 2] * inner * (1 - r)
    carry, ds, to_state = np.zeros((h, n), kind), np.empty((steps, h, n), kind), np.empty((steps, 3 * h, n), kind)
    for t in range(steps - 1, -1, -1):
        d = np.add(back[t], carry, out=ds[t])
        np.multiply(d, times[t], out=to_state[t].reshape(3, h, n))
        carry = p["u"] @ to_state[t]
        carry += d * z[t]
        if begins[t]:
            carry[:, start[t]] = 0
    offs = to_state.copy()
    np.multiply(ds, to_inner, out=offs[:, 2 * h :])
    grad["u"] = np.matmul(before, to_state.transpose(0, 2, 1)).sum(0)
    ids, grad["x"] = _sums(inputs.reshape(-1), offs.transpose(0, 2, 1).reshape(-1, 3 * h))
    grad["b"] = grad["x"].sum(0)
    return float(logp.sum()), grad, ids, after[-1]


def fresh(p: Weights) -> Weights:
    return {k: np.full_like(x, 1e-2) for k, x in p.items()}


def train(p: Weights, v: Vocabulary, docs: list[np.ndarray], seen: Weights | None = None, most: int = TRAIN_LANES) -> Weights:
    """One pass of truncated backpropagation over every token with per-weight rates; the state goes on from window to window. seen: squares of earlier gradients, to which these are added."""
    p = {k: x.copy() for k, x in p.items()}
    seen = fresh(p) if seen is None else seen
    lanes = sum(map(len, docs)) // (STEPS * UPDATES)  # few tokens go in fewer lanes, so that there are updates enough
    lay = Lanes(docs, min(most, max(LEAST_LANES, lanes)))
    steps, lanes = lay.target.shape
    state = np.zeros((HIDDEN, lanes), np.float32)
    for at in range(0, steps, STEPS):
        n = lay.active(at)
        to = min(steps, at + STEPS)
        live = np.arange(at, to)[:, None] < lay.sizes[:n]
        _, grad, rows, after = gradients(p, v, lay.input[at:to, :n], lay.target[at:to, :n], live, state[:, :n])
        state[:, :n] = after
        scale = np.float32(1 / max(1, n))
        for k, g in grad.items():
            to = rows if k == "x" else slice(None)
            g *= scale
            np.clip(g, -CLIP, CLIP, out=g)
            seen[k][to] += g * g
            g *= LEARN
            p[k][to] -= g / np.sqrt(seen[k][to])
    return p


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for some in gathered(batches, 0, COUNTED_AT_ONCE):
        counts = pc.value_counts(split(whole(some.column(0)))[0])
        words = pa.concat_arrays([counts.field(0), pa.array([END], pa.binary())])
        yield pa.RecordBatch.from_arrays([words, pa.concat_arrays([counts.field(1), pa.array([some.num_rows], pa.int64())])], names=["word", "n"])


def count_words(spark: SparkSession, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """word, c of all texts, written."""
    counted = texts.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))
    return scratch.write(counted, "counts")


def vocabulary(counts: DataFrame) -> Vocabulary:
    of_class = F.crc32(F.expr("substring(word, greatest(octet_length(word) - 1, 1), 2)")) % RARE
    # a row for each rare class
    rare = {r["b"]: (r["n"], r["v"]) for r in counts.groupBy(of_class.alias("b")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    head = counts.orderBy(F.desc("c"), "word").limit(HEAD).toArrow()  # at most HEAD words
    rows = sorted(zip(head["word"].to_pylist(), head["c"].to_pylist(), strict=True), key=lambda r: (-r[1], r[0]))
    return Vocabulary(rows, sum(n for n, _ in rare.values()), sum(v for _, v in rare.values()), rare)


CHUNK, SUM_LANES = 8192, 16


def _pack(p: Weights) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _unpack(flat: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


ENCODED = "row long, key long, train boolean, n_tokens long, n_head long, base_head double, rare double, net binary, tail array<binary>, tail_n array<long>"


def encode(spark: SparkSession, docs: DataFrame, v: Vocabulary, scratch: Scratch) -> DataFrame:
    """Every row of docs (doc_id, key, train, text) as network ids, with its known part of the base score and the words beyond the head; written."""
    words = spark.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v, row = words.value, TaskContext.get().partitionId() << 40
        for b in gathered(batches, 3, TEXT_AT_ONCE):
            if not b.num_rows:
                continue
            n, head, net, tail, of = v.encode_all(whole(b.column(3)))
            first = np.cumsum(n) - n
            known, rare, counts, within = head >= 0, net >= MODEL_WORDS, np.zeros(len(head)), np.zeros(len(head))
            counts[known] = v.log_count[head[known]]
            within[rare] = counts[rare] - v.rare_total[net[rare] - MODEL_WORDS]
            total = lambda x: np.add.reduceat(x, first)
            # each word beyond the head once for each text
            tail = tail.dictionary_encode()
            n_words = max(1, len(tail.dictionary))
            pairs, times = np.unique(of * n_words + tail.indices.to_numpy(zero_copy_only=False), return_counts=True)
            ends = pa.array(np.searchsorted(pairs, np.arange(b.num_rows + 1) * n_words), pa.int32())
            nets = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(np.r_[0, np.cumsum(2 * n)].astype(np.int32)), pa.py_buffer(net.astype("<u2"))])
            yield pa.RecordBatch.from_arrays([
                whole(b.column(0)), pa.array(np.arange(row, row + b.num_rows)), whole(b.column(1)), whole(b.column(2)),
                pa.array(n), pa.array(total(known.astype(np.int64))), pa.array(total(counts) - n * v.base_total), pa.array(total(within)), nets,
                pa.ListArray.from_arrays(ends, tail.dictionary.take(pa.array(pairs % n_words))), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int64))),
            ], names=names)
            row += b.num_rows

    names = ["doc_id", *(x.split()[0] for x in ENCODED.split(", "))]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return scratch.write(docs.select("doc_id", "key", "train", "text").mapInArrow(run, f"doc_id {kind}, {ENCODED}"), "encoded")


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows (lane, chunk, n, sums) of each chunk, whose rows follow each other."""
    lane, chunk, n, sums = 0, None, 0, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lane], pa.int32()), pa.array([chunk], pa.int32()), pa.array([n], pa.int64()), pa.array([sums], pa.list_(pa.float64()))], names=["lane", "chunk", "n", "sums"])

    for b in batches:
        for k, x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            if k != chunk:
                if chunk is not None:
                    yield row()
                chunk, n, sums = k, 0, 0.0
            n, sums = n + x, sums + y.values.to_numpy()
    if chunk is not None:
        yield row()


def _averaged(spark: SparkSession, dealt: DataFrame, words: Broadcast, start: tuple[Weights, Weights], with_seen: bool, most: int) -> list[np.ndarray]:
    """Weights, and with_seen squares of gradients, averaged by tokens over the shares of dealt (share, key, net), each trained from the start; packed in chunks."""
    shared = spark.sparkContext.broadcast(start)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        docs, share, size, n, sums = [], None, 0, 0, 0.0

        def close() -> None:
            nonlocal docs, size, n, sums
            p, seen = shared.value
            seen = {k: x.copy() for k, x in seen.items()}
            p = train(p, words.value, docs, seen, most)
            sums = sums + np.concatenate([_pack(p), _pack(seen) if with_seen else []]) * np.float64(size)
            docs, size, n = [], 0, n + size

        for b in batches:
            for k, net in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                if docs and (k != share or size >= 2 * SHARE_TOKENS):
                    close()
                share = k
                docs.append(np.frombuffer(net.as_py(), "<u2").astype(np.int32))
                size += len(docs[-1])
        if docs:
            close()
        if n:  # one sum a task, in chunks
            lane = TaskContext.get().partitionId() % SUM_LANES
            chunks = [sums[i : i + CHUNK] for i in range(0, len(sums), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array([lane] * len(chunks), pa.int32()), pa.array(range(len(chunks)), pa.int32()), pa.array([n] * len(chunks), pa.int64()), pa.array(chunks, pa.list_(pa.float64()))], names=["lane", "chunk", "n", "sums"])

    rows = dealt.mapInArrow(learn, SUMS)
    # first the tasks of each lane, then the lanes
    some = rows.repartition("chunk", "lane").sortWithinPartitions("chunk", "lane").mapInArrow(_add, SUMS)
    rows = some.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_add, SUMS).collect()  # the size of the weights
    return [np.array(r["sums"]) / r["n"] for r in sorted(rows, key=lambda r: r["chunk"])]


def fit(spark: SparkSession, encoded: DataFrame, v: Vocabulary) -> Weights:
    """Weights averaged over shares of the rows (key, net, n_tokens), each trained from common weights.

    Nets that part at random weights have no useful mean. So if there are several shares, the first part of the texts, a third of a share,
    trains alone, and the shares of all others go on from its weights and rates. A row's part and share depend on its key alone, and rows
    are trained in the order of their keys, so the way the rows are partitioned doesn't matter.
    """
    p = initial(v)
    total = encoded.agg(F.sum("n_tokens")).first()[0]
    if not total:
        return p
    words = spark.sparkContext.broadcast(v)
    n_shares, n_parts = max(1, round(total / SHARE_TOKENS)), round(3 * total / SHARE_TOKENS)
    dealt, seen = encoded.select(F.pmod("key", F.lit(n_shares)).alias("share"), "key", "net"), fresh(p)
    if n_shares > 1:
        part = F.pmod(F.shiftrightunsigned("key", 32), F.lit(n_parts))  # bits that the share hardly depends on
        first = dealt.filter(part == 0).withColumn("share", F.lit(0).cast("long")).repartition(1).sortWithinPartitions("key")  # about SHARE_TOKENS / 3 tokens, however many there are
        chunks = _averaged(spark, first, words, (p, seen), True, TRAIN_LANES)
        if chunks:
            flat = np.concatenate(chunks)
            half = len(flat) // 2
            p, seen = _unpack(flat[:half], p), _unpack(flat[half:], seen)
        dealt = dealt.filter(part != 0)
    dealt = dealt.repartitionByRange(max(min(n_shares, 64), n_shares // 4), "share").sortWithinPartitions("share", "key")
    chunks = _averaged(spark, dealt, words, (p, seen), False, LATER_LANES if n_shares > 1 else TRAIN_LANES)
    return _unpack(np.concatenate(chunks), p) if chunks else p


SUMS = "lane int, chunk int, n long, sums array<double>"


def score(spark: SparkSession, docs: DataFrame, held_out: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    tune(spark)
    scratch = Scratch(spark, "lm")
    own = docs.select(F.col(doc_id).alias("doc_id"), body(text).alias("text")).withColumn("train", fold("doc_id") != held_out)
    counts = count_words(spark, own.filter("train").select("text"), scratch)
    v = vocabulary(counts)
    encoded = encode(spark, own.withColumn("key", F.xxhash64("doc_id", "text", F.lit(5))), v, scratch)
    p = fit(spark, encoded.filter("train"), v)
    words, weights = spark.sparkContext.broadcast(v), spark.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def rate() -> pa.RecordBatch:
            nets = [np.frombuffer(x, "<u2") for b in held for x in b.column(len(names) - 1).to_pylist()]
            table = pa.Table.from_batches(held).drop_columns(["net"]).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([*table.columns, pa.array(log_likelihoods(weights.value, words.value, nets))], names=[*names[:-1], "likelihood"])

        for b in batches:
            held.append(b)
            n += sum(b.column(2).to_pylist())
            if n >= TOKENS_AT_ONCE:
                yield rate()
                held, n = [], 0
        if n:
            yield rate()

    names = ["doc_id", "row", "n_tokens", "train", "n_head", "base_head", "rare", "net"]
    kind = docs.schema[doc_id].dataType.simpleString()
    rated = scratch.write(encoded.select(*names).mapInArrow(run, f"doc_id {kind}, row long, n_tokens long, train boolean, n_head long, base_head double, rare double, likelihood double"), "rated")
    beyond = encoded.select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.tail_n").alias("n"))
    met = beyond.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("log_count"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_beyond")
    )
    some = F.coalesce("log_count", F.lit(0.0))
    return rated.join(met, "row", "left").select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_head") + F.coalesce("n_beyond", F.lit(0))).alias("n_known"),
        F.lit(v.n_tokens).cast("long").alias("train_tokens"), (F.col("base_head") + some).alias("base_score"), (F.col("likelihood") + F.col("rare") + some).alias("score"),
    )
