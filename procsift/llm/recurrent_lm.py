"""LM scoring with a gated recurrent network, in numpy."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procsift.llm.common import crc_remainder, stored, text_of

FOLDS, HELD_OUT = 7, 2
#: Stands for the end of a text in tables of words; no word has white space.
END = b" "

#: Words whose counts go to every task, at most.
FREQUENT_WORDS = 100_000
#: Words of the network's own vocabulary: CLASSES of WIDTH.
CLASSES, WIDTH = 16, 64
EMBEDDING, HIDDEN = 12, 16
#: Lanes that run side by side, and tokens of a window. Where few lanes are left
#: to score, windows grow, up to LONGEST_WINDOW.
SCORE_LANES, SCORE_WINDOW, LONGEST_WINDOW = 512, 24, 1024
TRAIN_LANES, TRAIN_WINDOW = 256, 12
#: Probabilities are worked out for so many tokens at a time, which a cache can hold.
BLOCK = 2048
#: A gradient step has so many tokens behind it.
STEP_TOKENS = TRAIN_LANES * TRAIN_WINDOW
#: Training takes longer documents in parts of so many tokens, side by side.
TRAIN_PART = 1024
#: Every training document takes part in one gradient pass; they are dealt out
#: over ROUNDS, with the mean of all tasks' weights between.
ROUNDS = 3
LEARNING_RATE = 0.01
COUNTER_WORDS = 200_000

# Rare words are told apart by shape: how they end, and whether they are ASCII.
_SHAPES = 12


def shape(word: bytes) -> int:
    """The tail class of a word: its last byte's kind, and whether it is ASCII."""
    last = word[-1]
    if 97 <= last <= 122 or last >= 128:
        kind = 0
    elif last == 46:
        kind = 1
    elif last in b",;:":
        kind = 2
    elif last == 33:
        kind = 3
    elif 48 <= last <= 57:
        kind = 4
    else:
        kind = 5
    return kind if word.isascii() else kind + 6


@dataclass(frozen=True)
class Lexicon:
    """What tasks need of the corpus counts; its size is bounded by FREQUENT_WORDS.

    ``index`` places frequent words by falling count; those before ``own`` are
    the network's vocabulary. ``log_count`` is log10(c + 1) by place, ``shapes``
    the tail class by place. ``tail_log`` is log10 of what divides a count in
    each tail class: all its training tokens and words, and one for the unseen.
    """

    index: dict[bytes, int]
    log_count: np.ndarray
    shapes: np.ndarray
    own: int
    own_counts: np.ndarray
    tail_tokens: np.ndarray
    tail_log: np.ndarray
    tokens: int
    words: int

    @property
    def groups(self) -> int:
        return CLASSES + _SHAPES

    @property
    def start(self) -> int:
        """The input before a text's first token."""
        return CLASSES * WIDTH + _SHAPES


@dataclass
class Encoded:
    """A text as the network sees it."""

    inputs: np.ndarray
    targets: np.ndarray
    fixed: float
    base: float
    n_tokens: int
    n_known: int
    rare: list[bytes]


def encode(text: bytes, lexicon: Lexicon) -> Encoded:
    """Words to ids: below CLASSES*WIDTH the network's own, above it tail classes.

    ``fixed`` is the share of the score that no network decides, ``base`` the
    sum of log10(c + 1); both lack the counts of the ``rare`` words.
    """
    words = text.lower().split()
    words.append(END)
    get = lexicon.index.get
    places = np.fromiter(map(get, words, repeat(-1)), dtype=np.int64, count=len(words))
    ids = places.copy()
    unknown = np.flatnonzero(places < 0)
    rare = [words[i] for i in unknown]
    first_tail = CLASSES * WIDTH
    tail = places >= lexicon.own
    ids[tail] = first_tail + lexicon.shapes[places[tail]]
    ids[unknown] = [first_tail + shape(w) for w in rare]
    known = places[places >= 0]
    base = float(lexicon.log_count[known].sum())
    fixed = float(lexicon.log_count[places[tail]].sum())
    in_tail = ids[ids >= first_tail] - first_tail
    fixed -= float(lexicon.tail_log[in_tail].sum())
    ids = ids.astype(np.int32)
    return Encoded(_inputs(ids, lexicon.start), ids, fixed, base, len(words), len(known), rare)


def _inputs(targets: np.ndarray, start: int) -> np.ndarray:
    """What the network sees before each target."""
    inputs = np.empty_like(targets)
    inputs[0], inputs[1:] = start, targets[:-1]
    return inputs


def _again(ids: bytes) -> Encoded:
    """A stored text, as far as the network needs it."""
    targets = np.frombuffer(ids, dtype="<i2").astype(np.int32)
    return Encoded(_inputs(targets, CLASSES * WIDTH + _SHAPES), targets, 0.0, 0.0, len(targets), 0, [])


_ENCODED = (
    "doc_id bigint, held_out boolean, ids binary, n_tokens bigint, n_known bigint, base double, fixed double, "
    "rare array<binary>"
)


def encoded(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Every text (doc_id, held_out, text) as ids and what else its score needs,
    so that each text is taken apart once for training and scoring. ``ids`` are
    little-endian 16-bit numbers."""
    known = docs.sparkSession.sparkContext.broadcast(lexicon)
    names = ("n_tokens", "n_known", "base", "fixed", "rare")
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                found = [encode(text.as_py(), known.value) for text in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([f.targets.astype("<i2").tobytes() for f in found], pa.binary()),
                        *[pa.array([getattr(f, n) for f in found], k) for n, k in zip(names, kinds, strict=True)],
                    ],
                    names=["doc_id", "held_out", "ids", *names],
                )

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, _ENCODED)


Weights = dict[str, np.ndarray]
_NAMES = ("emb", "wx", "bx", "wh", "bn", "wc", "bc", "wo", "bo")


def shapes_of_weights() -> dict[str, tuple[int, ...]]:
    groups = CLASSES + _SHAPES
    return {
        "emb": (CLASSES * WIDTH + _SHAPES + 1, EMBEDDING),
        "wx": (EMBEDDING, 3 * HIDDEN),
        "bx": (3 * HIDDEN,),
        "wh": (HIDDEN, 3 * HIDDEN),
        "bn": (HIDDEN,),
        "wc": (HIDDEN, groups),
        "bc": (groups,),
        "wo": (CLASSES, HIDDEN, WIDTH),
        "bo": (CLASSES, WIDTH),
    }


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[n].ravel() for n in _NAMES]).astype(np.float64)


def unflat(values: np.ndarray) -> Weights:
    out, at = {}, 0
    for name, size in shapes_of_weights().items():
        n = int(np.prod(size))
        out[name] = np.asarray(values[at : at + n], dtype=np.float32).reshape(size).copy()
        at += n
    return out


def first_weights(lexicon: Lexicon, seed: int = 7) -> Weights:
    """Small random weights; biases give the training counts, so that the
    network starts as a unigram model."""
    random = np.random.default_rng(seed)
    weights = {
        name: (random.standard_normal(size) * (0.1 if name == "emb" else 0.08)).astype(np.float32)
        for name, size in shapes_of_weights().items()
    }
    counts = np.zeros(CLASSES * WIDTH)
    counts[: lexicon.own] = lexicon.own_counts
    counts = counts.reshape(CLASSES, WIDTH)
    weights["bx"][:] = 0
    weights["bn"][:] = 0
    weights["bo"] = np.log(counts + 1e-3).astype(np.float32)
    groups = np.concatenate([counts.sum(axis=1), lexicon.tail_tokens + 1.0])
    weights["bc"] = np.log((groups + 1e-3) / (groups.sum() + 1)).astype(np.float32)
    return weights


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|): as smooth as a hyperbolic tangent, and far cheaper. Takes ``x``'s place."""
    below = np.abs(x)
    below += 1
    return np.divide(x, below, out=x)


def _slope(x: np.ndarray) -> np.ndarray:
    """The slope of the squash where it gave ``x``."""
    rest = np.abs(x)
    np.subtract(1, rest, out=rest)
    return np.square(rest, out=rest)


def _turned(x: np.ndarray) -> np.ndarray:
    """The last two axes swapped, in memory too."""
    return np.ascontiguousarray(np.swapaxes(x, -1, -2))


def _run_window(w: Weights, ids: np.ndarray, state: np.ndarray, keep: bool):
    """States after each step of a window (T, B, H); what the way back needs if ``keep``.

    Inside, a step has its lanes side by side in memory (H, B): gates are then
    whole rows, and what is done with them runs over long stretches.
    """
    steps, lanes = ids.shape
    both = 2 * HIDDEN
    table = _turned(w["emb"] @ w["wx"] + w["bx"])
    states = np.empty((steps, HIDDEN, lanes), dtype=np.float32)
    memory = []
    into, shift, state = w["wh"].T, w["bn"][:, None], _turned(state)
    for t in range(steps):
        recur, given = into @ state, np.take(table, ids[t], axis=1, mode="clip")
        signs = _squash(given[:both] + recur[:both])
        gates = 0.5 * signs
        gates += 0.5
        update, reset = gates[:HIDDEN], gates[HIDDEN:]
        inner = recur[both:]
        inner += shift
        new = reset * inner
        new += given[both:]
        new = _squash(new)
        before, state = state, state - new
        state *= update
        state += new
        states[t] = state
        if keep:
            memory.append((before, update, reset, inner, new, signs))
    return _turned(states), memory


def _exponents(x: np.ndarray, safe: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """exp of the rows, scaled where they are large, and the logs of their sums.
    Adds to ``x`` in place. Values that are ``safe`` need no look."""
    if not safe:
        most = float(x.max()) if x.size else 0.0
        if most > 60 or float(x.min(initial=0.0)) < -80:
            x -= x.max(axis=1, keepdims=True)
    e = np.exp(x, out=x)
    return e, e @ np.ones(e.shape[1], dtype=e.dtype)  # far faster than a sum of each row


def _safe(weight: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no state, whose parts lie between -1 and 1, can lead to a value
    that _exponents would scale."""
    most = np.abs(weight).sum(axis=-2)
    return bool((bias + most).max() < 59 and (bias - most).min() > -79)


def _groups(targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each target, tail classes last, and its place in the class."""
    own = CLASSES * WIDTH
    inside = targets < own
    group = np.where(inside, targets // WIDTH, targets - own + CLASSES)
    return group, np.where(inside, targets % WIDTH, -1)


def _by_class(group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """The rows that have words of the network's own, class by class, and where
    among them each class that has any lies."""
    order = np.argsort(group.astype(np.int8), kind="stable")
    edges = np.append(0, np.cumsum(np.bincount(group, minlength=CLASSES)[:CLASSES])).tolist()
    return order[: edges[-1]], [
        (c, slice(edges[c], edges[c + 1])) for c in range(CLASSES) if edges[c] < edges[c + 1]
    ]


def log_probabilities(w: Weights, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log probability of each target's class and, for the network's
    own words, of the word in its class."""
    group, place = _groups(targets)
    rows, safe = np.arange(len(targets)), _safe(w["wc"], w["bc"])
    share = np.empty(len(targets), dtype=w["wc"].dtype)
    for start in range(0, len(targets), BLOCK):
        at = slice(start, start + BLOCK)
        x = states[at] @ w["wc"]
        x += w["bc"]
        e, total = _exponents(x, safe)
        share[at] = e[rows[: len(e)], group[at]] / total
    out = np.log(share + _TINY)
    order, classes = _by_class(group)
    held, place, safe = states[order], place[order], _safe(w["wo"], w["bo"])
    share = np.empty(len(order), dtype=out.dtype)
    for c, at in classes:
        x = held[at] @ w["wo"][c]
        x += w["bo"][c]
        e, total = _exponents(x, safe)
        share[at] = e[rows[: len(e)], place[at]] / total
    out[order] += np.log(share + _TINY)
    return out.astype(np.float64)


#: Keeps a logarithm finite where a single-precision share underflows.
_TINY = np.float32(1e-30)
#: Adam: how much of the moments stays at each step, and what keeps the rarest
#: words from jumping with their first gradient.
_KEEP_FIRST, _KEEP_SECOND, _FLOOR = np.float32(0.9), np.float32(0.99), np.float32(1e-4)


class Trainer:
    """Truncated backpropagation through time with Adam steps.

    Gradients add up over windows until STEP_TOKENS tokens are behind them, so
    every step has the weight that the rate was chosen for, however few lanes a
    window has. What is left at the end makes a step as much shorter.
    """

    def __init__(self, weights: Weights, rate: float = LEARNING_RATE) -> None:
        self.w, self.rate = weights, rate
        self.first = {n: np.zeros_like(v) for n, v in weights.items()}
        self.second = {n: np.zeros_like(v) for n, v in weights.items()}
        self.grads = {n: np.zeros_like(v) for n, v in weights.items()}
        self.steps, self.tokens = 0, 0

    def window(self, ids: np.ndarray, targets: np.ndarray, valid: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Add a window's gradients (T, B); they end at its first token. Returns the last state."""
        w, grads, (steps, lanes) = self.w, self.grads, ids.shape
        states, memory = _run_window(w, ids, state, keep=True)
        at = np.flatnonzero(valid.ravel())
        if not len(at):
            return states[-1]
        hidden, rows = states.reshape(-1, HIDDEN)[at], np.arange(len(at))
        group, place = _groups(targets.ravel()[at])
        error = hidden @ w["wc"]
        error += w["bc"]
        error, total = _exponents(error, _safe(w["wc"], w["bc"]))
        error /= total[:, None]
        error[rows, group] -= 1
        grads["wc"] += hidden.T @ error
        grads["bc"] += np.ones(len(at), dtype=error.dtype) @ error
        back = error @ w["wc"].T
        order, classes = _by_class(group)
        held, place, safe = hidden[order], place[order], _safe(w["wo"], w["bo"])
        more = np.empty((len(order), HIDDEN), dtype=back.dtype)
        for c, own in classes:
            error = held[own] @ w["wo"][c]
            error += w["bo"][c]
            error, total = _exponents(error, safe)
            error /= total[:, None]
            error[rows[: len(error)], place[own]] -= 1
            grads["wo"][c] += held[own].T @ error
            grads["bo"][c] += np.ones(len(error), dtype=error.dtype) @ error
            np.matmul(error, w["wo"][c].T, out=more[own])
        back[order] += more
        outer = np.zeros((steps * lanes, HIDDEN), dtype=np.float32)
        outer[at] = back
        outer = _turned(outer.reshape(steps, lanes, HIDDEN))
        inputs = np.empty((steps, 3 * HIDDEN, lanes), dtype=np.float32)
        inners = np.empty((steps, HIDDEN, lanes), dtype=w["wh"].dtype)
        recur = np.empty((3 * HIDDEN, lanes), dtype=w["wh"].dtype)
        d_state = np.zeros((HIDDEN, lanes), dtype=np.float32)
        for t in reversed(range(steps)):
            before, update, reset, inner, new, signs = memory[t]
            d_state = d_state + outer[t]
            d_new = 1 - update
            d_new *= d_state
            d_new *= _slope(new)
            d_gates, d_inner = recur[: 2 * HIDDEN], recur[2 * HIDDEN :]
            np.multiply(d_new, reset, out=d_inner)
            np.subtract(before, new, out=d_gates[:HIDDEN])
            d_gates[:HIDDEN] *= d_state
            np.multiply(d_new, inner, out=d_gates[HIDDEN:])
            slope = _slope(signs)
            slope *= 0.5
            d_gates *= slope
            inputs[t, : 2 * HIDDEN], inputs[t, 2 * HIDDEN :] = d_gates, d_new
            inners[t] = d_inner
            grads["wh"] += before @ recur.T
            d_state *= update
            d_state += w["wh"] @ recur
        grads["bn"] += (inners @ np.ones(lanes, dtype=inners.dtype)).sum(axis=0)
        inputs = _turned(inputs).reshape(-1, 3 * HIDDEN)
        embedded = w["emb"][ids].reshape(-1, EMBEDDING)
        grads["wx"] += embedded.T @ inputs
        grads["bx"] += np.ones(len(inputs), dtype=inputs.dtype) @ inputs
        into, rows, flat_ids = _turned(inputs @ w["wx"].T), len(w["emb"]), ids.ravel().astype(np.intp)
        for k in range(EMBEDDING):  # far faster than adding row by row
            grads["emb"][:, k] += np.bincount(flat_ids, into[k], minlength=rows)
        self.tokens += len(at)
        if self.tokens >= STEP_TOKENS:
            self.step()
        return states[-1]

    def step(self) -> None:
        """One Adam step by the mean gradient since the last."""
        if not self.tokens:
            return
        share = min(1.0, self.tokens / STEP_TOKENS)
        for grad in self.grads.values():
            grad /= np.float32(self.tokens)
        size = np.sqrt(sum(float((g * g).sum()) for g in self.grads.values()))
        clip = np.float32(min(1.0, 1.0 / (size + 1e-12)))
        self.steps += 1
        low, high = 1 - _KEEP_FIRST**self.steps, 1 - _KEEP_SECOND**self.steps
        for name, grad in self.grads.items():
            grad *= clip
            first, second = self.first[name], self.second[name]
            first += (1 - _KEEP_FIRST) * (grad - first)
            second += (1 - _KEEP_SECOND) * (grad * grad - second)
            self.w[name] -= np.float32(share * self.rate / low) * first / (np.sqrt(second / np.float32(high)) + _FLOOR)
            grad[:] = 0
        self.tokens = 0


class Lanes:
    """Documents side by side: each lane takes the next one when its own ends,
    and carries its state from window to window."""

    def __init__(
        self, lanes: int, window: int, documents: Iterator[tuple[object, Encoded]], longest: int | None = None
    ) -> None:
        self.window, self.documents = window, documents
        self.full, self.longest = lanes * window, longest or window
        self.held: list[tuple[object, Encoded]] = []
        # All held documents' targets, and each lane's place and end there, the
        # token before that place and its log probability so far.
        self.tokens, self.before = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
        self.place, self.end = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.log = np.zeros(0)
        self.state = np.zeros((0, HIDDEN), dtype=np.float32)
        self.most = lanes

    def fill(self) -> bool:
        fresh = list(islice(self.documents, self.most - len(self.held)))
        if fresh:
            if len(self.tokens) > 2 * int((self.end - self.place).sum()):  # most of it is done with
                left = [self.tokens[a:b] for a, b in zip(self.place.tolist(), self.end.tolist(), strict=True)]
                self.tokens, sizes = np.concatenate([self.tokens[:0], *left]), self.end - self.place
                self.end = np.cumsum(sizes)
                self.place = self.end - sizes
            ends = len(self.tokens) + np.cumsum([len(d.targets) for _, d in fresh])
            starts = np.append(len(self.tokens), ends[:-1])
            self.tokens = np.concatenate([self.tokens, *(d.targets for _, d in fresh)])
            self.place, self.end = np.append(self.place, starts), np.append(self.end, ends)
            self.before = np.append(self.before, np.array([d.inputs[0] for _, d in fresh], dtype=np.int32))
            self.log = np.append(self.log, np.zeros(len(fresh)))
            self.held += fresh
            self.state = np.concatenate([self.state, np.zeros((len(fresh), HIDDEN), dtype=np.float32)])
        if len(self.held) < self.most:  # the last documents: as many tokens in fewer, longer windows
            self.window = max(self.window, min(self.longest, self.full // max(1, len(self.held))))
        return bool(self.held)

    def slices(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """inputs, targets and what of them is real, each (T, B)."""
        at = np.arange(self.window)[:, None] + self.place
        valid = at < self.end
        targets = np.where(valid, self.tokens.take(at, mode="clip"), 0)
        # Every input but a document's first is the target before it.
        inputs = np.concatenate([self.before[None], targets[:-1]])
        self.before = targets[-1]
        return inputs, targets, valid

    def advance(self, state: np.ndarray, gained: np.ndarray | None = None) -> Iterator[tuple[object, Encoded, float]]:
        """Move on by a window; gives the documents that ended, and their lanes free."""
        self.place = self.place + self.window
        if gained is not None:
            self.log = self.log + gained
        stay = self.place < self.end
        over, log = [self.held[lane] for lane in np.flatnonzero(~stay)], self.log[~stay].tolist()
        if over:
            self.place, self.end, self.log, self.before = (x[stay] for x in (self.place, self.end, self.log, self.before))
            self.held, state = [self.held[lane] for lane in np.flatnonzero(stay)], state[stay]
        self.state = state
        for (key, document), value in zip(over, log, strict=True):
            yield key, document, value


def score_documents(w: Weights, documents: Iterator[tuple[object, Encoded]]) -> Iterator[tuple[object, Encoded, float]]:
    """(key, document, natural log probability by the network) of each whole document."""
    lanes = Lanes(SCORE_LANES, SCORE_WINDOW, documents, LONGEST_WINDOW)
    while lanes.fill():
        inputs, targets, valid = lanes.slices()
        states, _ = _run_window(w, inputs, lanes.state, keep=False)
        at = np.flatnonzero(valid.ravel())
        logs = np.zeros(valid.size)
        logs[at] = log_probabilities(w, states.reshape(-1, HIDDEN)[at], targets.ravel()[at])
        yield from lanes.advance(states[-1], logs.reshape(valid.shape).sum(axis=0))


def _parts(item: tuple[object, Encoded]) -> Iterator[tuple[object, Encoded]]:
    key, document = item
    for start in range(0, len(document.targets), TRAIN_PART):
        end = start + TRAIN_PART
        yield key, replace(document, inputs=document.inputs[start:end], targets=document.targets[start:end])


def train_documents(weights: Weights, documents: Iterator[tuple[object, Encoded]]) -> tuple[Weights, int]:
    """Weights after one pass, and the tokens it saw.

    A document of over TRAIN_PART tokens takes part as several lanes, each of
    which begins without a state, so the longest ones don't run on alone.
    """
    trainer, tokens = Trainer(weights), 0
    lanes = Lanes(TRAIN_LANES, TRAIN_WINDOW, (part for d in documents for part in _parts(d)))
    while lanes.fill():
        inputs, targets, valid = lanes.slices()
        state = trainer.window(inputs, targets, valid, lanes.state)
        tokens += int(valid.sum())
        for _ in lanes.advance(state):
            pass
    trainer.step()
    return trainer.w, tokens


def held_out(doc_id):
    return crc_remainder(doc_id, FOLDS) == HELD_OUT


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all rows; the end of a text is a word too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                names=["word", "n"],
            )

        for batch in batches:
            for text in batch.column(0):
                words = text.as_py().lower().split()
                counts.update(words)
                counts[END] += 1
                if len(counts) > COUNTER_WORDS:
                    yield rows()
                    counts.clear()
        if counts:
            yield rows()

    return (
        docs.select("text")
        .mapInArrow(run, "word binary, n bigint")
        .groupBy("word")
        .agg(F.sum("n").alias("c"))
    )


def _shape_column(word):
    last = F.substring(word, F.length(word), F.lit(1))
    code = F.conv(F.hex(last), 16, 10).cast("int")
    kind = (
        F.when((code >= 128) | code.between(97, 122), 0)
        .when(code == 46, 1)
        .when(code.isin(44, 58, 59), 2)
        .when(code == 33, 3)
        .when(code.between(48, 57), 4)
        .otherwise(5)
    )
    return kind + F.when(F.hex(word).rlike("^(?:[0-7].)*+$"), 0).otherwise(6)


def build_lexicon(counts: DataFrame, frequent: int = FREQUENT_WORDS) -> tuple[Lexicon, int]:
    """The lexicon of stored counts, and the least count of a frequent word.

    That count is the lowest that at most ``frequent`` words reach, found on a
    grid of eight steps for each doubling; only those words leave Spark.
    """
    step = F.floor(F.log2("c") * 8).cast("int")
    grid = {
        r["step"]: (r["n"], r["tokens"])
        for r in counts.groupBy(step.alias("step"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("tokens"))
        .collect()
    }
    least, total = None, 0
    for s in sorted(grid, reverse=True):
        total += grid[s][0]
        if total > frequent:
            break
        least = s
    found = counts.where(step >= least).collect() if least is not None else []
    found.sort(key=lambda r: (-r["c"], bytes(r["word"])))
    words = [bytes(r["word"]) for r in found]
    number = np.array([r["c"] for r in found], dtype=np.float64)
    own = min(len(words), CLASSES * WIDTH)
    shapes = np.array([shape(x) for x in words], dtype=np.int64)
    tail_tokens, tail_words = np.zeros(_SHAPES), np.zeros(_SHAPES)
    for r in (
        counts.where(F.lit(least is None) | (step < (least or 0)))
        .groupBy(_shape_column(F.col("word")).alias("shape"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("tokens"))
        .collect()
    ):
        tail_tokens[r["shape"]] += r["tokens"]
        tail_words[r["shape"]] += r["n"]
    np.add.at(tail_tokens, shapes[own:], number[own:])
    np.add.at(tail_words, shapes[own:], 1)
    lexicon = Lexicon(
        index={x: i for i, x in enumerate(words)},
        log_count=np.log10(number + 1),
        shapes=shapes,
        own=own,
        own_counts=number[:own],
        tail_tokens=tail_tokens,
        tail_log=np.log10(tail_tokens + tail_words + 1),
        tokens=int(sum(t for _, t in grid.values())),
        words=int(sum(n for n, _ in grid.values())),
    )
    return lexicon, (least if least is not None else 1 << 30)


def rounds_of(docs: DataFrame) -> DataFrame:
    """(round, text or ids) of every row, the round being below ROUNDS."""
    number = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(ROUNDS)).cast("int")
    return docs.select(number.alias("round"), "ids" if "ids" in docs.columns else "text")


def train(docs: DataFrame, lexicon: Lexicon) -> Weights:
    """The network's weights, learnt by all tasks together.

    ``docs`` are the training documents, (doc_id, ids) as stored by ``encoded``
    or (doc_id, text). All take part, each once, in ROUNDS parts by hash. In each round every task starts from the common weights and
    makes one pass over its documents; Spark then averages the weights, by
    tokens. Only one set of weights at a time reaches the driver.
    """
    spark = docs.sparkSession
    weights = first_weights(lexicon)
    known = spark.sparkContext.broadcast(lexicon)
    dealt, ready = rounds_of(docs), "ids" in docs.columns
    for number in range(ROUNDS):
        shared = spark.sparkContext.broadcast(flat(weights))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            documents = (
                (None, _again(x.as_py()) if ready else encode(x.as_py(), known.value))
                for batch in batches
                for x in batch.column(0)
            )
            found, tokens = train_documents(unflat(shared.value), documents)
            if tokens:
                moved = flat(found) * tokens
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tokens], pa.int64()), pa.array([moved], pa.list_(pa.float64()))],
                    names=["tokens", "moved"],
                )

        parts = (
            dealt.where(F.col("round") == number)
            .drop("round")
            .mapInArrow(run, "tokens bigint, moved array<double>")
        )
        mean = (
            parts.select("tokens", F.posexplode("moved").alias("at", "x"))
            .groupBy("at")
            .agg((F.sum("x") / F.sum("tokens")).alias("x"))
            .toPandas()  # as many rows as the network has weights
        )
        if len(mean):
            values = np.empty(len(mean))
            values[mean["at"].to_numpy()] = mean["x"].to_numpy()
            weights = unflat(values)
    return weights


def scored(docs: DataFrame, frequent: int = FREQUENT_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model learns from rows outside the held-out fold. A text's log10
    probability is the sum over its words and its end. The network gives each
    token's class; the network's own words (the CLASSES * WIDTH most frequent)
    have a softmax inside their class, all others the add-one counts inside the
    tail class of their shape, where one unseen word has a share. State is
    carried from window to window through the whole text.

    Counts cover all training tokens. Frequent words' counts go to the tasks;
    rare words are joined with their counts by a shuffle.

    Null and empty texts have one token, the end. Rows that repeat a doc_id are
    scored each and count each. Without any training row nothing is known and
    every token is unseen.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.col("doc_id").cast("bigint"),
        held_out(docs["doc_id"]).alias("held_out"),
        text_of(docs).cast("binary").alias("text"),
    )
    counts = stored(word_counts(base.where(~F.col("held_out"))), "word-counts")
    lexicon, least = build_lexicon(counts, frequent)
    texts = stored(encoded(base, lexicon).withColumn("row", F.monotonically_increasing_id()), "lm-ids")
    weights = train(texts.where(~F.col("held_out")).select("doc_id", "ids"), lexicon)
    learnt = spark.sparkContext.broadcast(weights)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base", "fixed", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def documents() -> Iterator[tuple[object, Encoded]]:
            for batch in batches:
                ids, kept = batch.column(len(names)), [c.to_pylist() for c in batch.columns[:-1]]
                for i, key in enumerate(zip(*kept, strict=True)):
                    yield key, _again(ids[i].as_py())

        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            kinds = (
                pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()
            )
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*names[:5], "model", "row"]
            )

        for (*kept, fixed, row), _, log in score_documents(learnt.value, documents()):
            rows.append((*kept, log / np.log(10) + fixed, row))
            if len(rows) >= 1000:
                yield flush()
                rows.clear()
        if rows:
            yield flush()

    found = stored(
        texts.select(*names, "ids").mapInArrow(
            run,
            "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, model double, row bigint",
        ),
        "lm-scores",
    )
    step = F.floor(F.log2("c") * 8).cast("int")
    rare = (
        texts.select("row", F.explode("rare").alias("word"))
        .join(counts.where(step < least), "word")
        .groupBy("row")
        .agg(F.count(F.lit(1)).alias("met"), F.sum(F.log10(F.col("c") + 1)).alias("gain"))
        .withColumnRenamed("row", "_row")
    )
    every = lexicon.tokens + 1 * (lexicon.words + 1)
    met, gain = F.coalesce("met", F.lit(0)), F.coalesce("gain", F.lit(0.0))
    return found.join(rare, F.col("row") == F.col("_row"), "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + met).alias("n_known"),
        F.lit(lexicon.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + gain - F.col("n_tokens") * float(np.log10(every))).alias("base_score"),
        (F.col("model") + gain).alias("score"),
    )
