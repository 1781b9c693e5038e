"""Language ID: a bidirectional gated recurrent network over the bytes of a text.

One network reads the bytes forwards, one backwards; both states at a byte give it a probability for each
language, and a document's probabilities are the mean over all of its bytes. A text is read whole, in windows of
``BODY`` bytes; the ``CONTEXT`` bytes on either side of a window are read with it to bring the states up, each side by
the direction that comes from there, but only the window's own bytes are labelled, so each byte is labelled once. Windows of many documents go through the
network together, so time and memory do not depend on the length of a text.

Training is numpy, by backpropagation through time over windows of labelled documents: at most about ``per_language``
documents of each language (by a keyed hash of the id), and ``PIECES`` windows of each, evenly spaced. This is the only
bounded sample; it bounds the training, not the predictions. The windows lie in ``REPLICAS`` partitions; in each round every partition trains
a copy of the network on its own windows, and the mean of the copies starts the next round.

Defined cases: a text that is null or has no letter is ``und`` with score 0; an empty text too. A null language is no
label; a document without id is not held out, and its label is learned from. With no labelled text every row is ``und``. Ties go to the first
language in code-point order. Repeated rows get the same answer. Only ``doc_id``, ``text`` and, to learn, ``lang`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leadweave.llm.common import whole_text
from leadweave.session import settle

UNKNOWN = "und"
BODY, CONTEXT, HIDDEN = 192, 16, 16
PIECES, PIECE, REPLICAS, ROUNDS, SEED = 2, 96, 4, 3, 5
_ROWS, _BYTES_AT_ONCE = 512, 1 << 20
_PAD = 256  # stands for no byte


@dataclass(frozen=True)
class Network:
    """Weights of both directions: what a byte adds to the gates, what the state adds, and the state's say on each language."""

    byte: np.ndarray  # two tables of 257 rows, one below the other
    state: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def drawn(cls, languages: int, hidden: int, seed: int) -> Network:
        draw = np.random.default_rng(seed).standard_normal
        byte = draw((2 * (_PAD + 1), 3 * hidden)) * 0.3
        byte[:, :hidden] += 1  # keep the state, at first
        state = draw((2, hidden, 3 * hidden)) / np.sqrt(hidden)
        out = draw((2, hidden, languages)) / np.sqrt(hidden)
        return cls(*(w.astype(np.float32) for w in (byte, state, out, np.zeros(languages))))

    def weights(self) -> list[np.ndarray]:
        return [self.byte, self.state, self.out, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights()])

    def like(self, flat: np.ndarray) -> Network:
        parts, at = [], 0
        for w in self.weights():
            parts.append(flat[at:at + w.size].reshape(w.shape).astype(np.float32))
            at += w.size
        return Network(*parts)


@dataclass(frozen=True)
class Windows:
    """Stretches of *data*; of each, the bytes from ``low`` to ``high`` are its own."""

    data: np.ndarray
    start: np.ndarray
    low: np.ndarray
    high: np.ndarray
    end: np.ndarray

    @classmethod
    def cut(cls, data: np.ndarray, bounds: np.ndarray, body: int, context: int) -> tuple[Windows, np.ndarray]:
        """All windows of the texts between *bounds*, and the text that each is of."""
        sizes = np.diff(bounds)
        n = -(-sizes // body)
        row = np.repeat(np.arange(len(sizes)), n)
        low = bounds[row] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * body
        first, last = bounds[row], bounds[row + 1]
        high = np.minimum(low + body, last)
        return cls(data, np.maximum(low - context, first), low, high, np.minimum(high + context, last)), row

    def take(self, at: np.ndarray) -> Windows:
        return Windows(self.data, self.start[at], self.low[at], self.high[at], self.end[at])

    def steps(self) -> np.ndarray:
        """Rows of the byte tables by step, direction and window; the second direction starts at the end."""
        t = np.arange((self.end - self.start).max(initial=0))[:, None]
        inside = t < (self.end - self.start)[None, :]
        ways = [np.where(inside, at, 0) for at in (self.start + t, self.end - 1 - t)]
        forth, back = (np.where(inside, self.data[at].astype(np.int64), _PAD) for at in ways)
        return np.stack([forth, back + _PAD + 1], axis=1)

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """Like ``steps`` up to the last own byte of each direction, and by place and window, whether an own byte is there.

        Own bytes are the last steps of both directions, the second in reverse; a step before the first byte is no byte.
        """
        lead = max((self.low - self.start).max(), (self.end - self.high).max())
        size = (self.high - self.low).max()
        t = np.arange(lead + size)[:, None]
        steps = np.empty((lead + size, 2, len(self.low)), np.intp)
        for way, at, first, last in ((0, self.low - lead + t, self.start, self.high), (1, self.low + size - 1 + lead - t, self.low, self.end)):
            inside = (at >= first) & (at < last)
            steps[:, way] = np.where(inside, self.data[np.where(inside, at, 0)].astype(np.intp), _PAD)
        steps[:, 1] += _PAD + 1
        return steps, t[:size] < self.high - self.low

    def own(self) -> np.ndarray:
        """By step and window, whether a byte is the window's own."""
        t = np.arange((self.end - self.start).max(initial=0))[:, None] + self.start
        return (t >= self.low) & (t < self.high)

    def partner(self) -> np.ndarray:
        """By step and window, the step at which the other direction is at the same byte."""
        t = np.arange((self.end - self.start).max(initial=0))[:, None]
        return np.maximum(self.end - self.start - 1 - t, 0)


def _by_gate(weights: np.ndarray) -> np.ndarray:
    """Weights of the two gates and of the fresh state one behind the other, so that each lies in one piece."""
    return np.ascontiguousarray(np.stack(np.split(weights, 3, axis=-1)))


def _states(net: Network, steps: np.ndarray, keep: list | None = None) -> np.ndarray:
    """The state after each step, by step, direction and window; *keep* gets what the way back needs."""
    t, _, n = steps.shape
    size = net.state.shape[1]
    states = np.zeros((t + 1, 2, n, size), np.float32)
    byte, state = _by_gate(net.byte), _by_gate(net.state)
    # A gate is 1 / (1 + exp(-x)); the sign is put into the weights once.
    byte[:2] *= -1
    state[:2] *= -1
    given, own = np.empty((3, 2, n, size), np.float32), np.empty((3, 2, n, size), np.float32)
    gates, fresh = given[:2], given[2]
    with np.errstate(over="ignore"):
        for i in range(t):
            h, following = states[i], states[i + 1]
            np.take(byte, steps[i], axis=1, out=given, mode="clip")
            np.matmul(h, state, out=own)
            gates += own[:2]
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            if keep is not None:
                mine = own[2].copy()
            own[2] *= gates[1]
            fresh += own[2]
            np.tanh(fresh, out=fresh)
            if keep is not None:
                keep.append((gates[0].copy(), gates[1].copy(), fresh.copy(), mine))
            # z h + (1 - z) fresh
            np.subtract(h, fresh, out=following)
            following *= gates[0]
            following += fresh
    return states


def _chances(net: Network, states: np.ndarray, windows: Windows) -> np.ndarray:
    """Probabilities of the languages by step and window."""
    forth, back = states[1:, 0] @ net.out[0], states[1:, 1] @ net.out[1]
    logits = forth + np.take_along_axis(back, windows.partner()[:, :, None], axis=0) + net.bias
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    return logits


def _sums(net: Network, windows: Windows) -> np.ndarray:
    """By window, the sum of its own bytes' probabilities.

    The recurrence of ``_states`` over the sides that own bytes need. Only what the states say on the languages is kept.
    """
    steps, own = windows.sides()
    t, _, n = steps.shape
    size, lead = net.state.shape[1], t - len(own)
    byte, state = _by_gate(net.byte), _by_gate(net.state)
    byte[:2] *= -1
    state[:2] *= -1
    # A state of zeros stays so until the first byte.
    byte[:, [_PAD, 2 * _PAD + 1]] = 0
    byte[0, [_PAD, 2 * _PAD + 1]] = -1e4
    given, added = np.empty((3, 2, n, size), np.float32), np.empty((3, 2, n, size), np.float32)
    gates, fresh = given[:2], given[2]
    h, said = np.zeros((2, n, size), np.float32), np.empty((len(own), 2, len(net.bias), n), np.float32)
    with np.errstate(over="ignore"):
        for i in range(t):
            np.take(byte, steps[i], axis=1, out=given, mode="clip")
            np.matmul(h, state, out=added)
            gates += added[:2]
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            added[2] *= gates[1]
            fresh += added[2]
            np.tanh(fresh, out=fresh)
            h -= fresh
            h *= gates[0]
            h += fresh
            if i >= lead:
                said[i - lead] = np.matmul(h, net.out).transpose(0, 2, 1)
    # Languages lie before windows, so that every step below is over long rows.
    logits = said[:, 0]
    logits += said[::-1, 1]
    logits += net.bias[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    logits *= own[:, None]
    return logits.sum(axis=0).T


def pooled(net: Network, data: np.ndarray, bounds: np.ndarray, body: int = BODY, context: int = CONTEXT) -> np.ndarray:
    """By text, the mean of its bytes' probabilities; zeros where it has no byte."""
    windows, row = Windows.cut(data, bounds, body, context)
    sums = np.zeros((len(bounds) - 1, len(net.bias)))
    order = np.argsort(windows.start - windows.end, kind="stable")  # of about one length together
    for at in range(0, len(order), _ROWS):
        some = order[at:at + _ROWS]
        np.add.at(sums, row[some], _sums(net, windows.take(some)))
    return sums / np.maximum(np.diff(bounds), 1)[:, None]


def _joined(texts: list[str | bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t if isinstance(t, bytes) else t.encode("utf-8", "replace") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))]


# --- training -------------------------------------------------------------------------------------


def gradients(net: Network, windows: Windows, language: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean loss over the windows' own bytes, and its derivatives by each of the weights."""
    steps, keep = windows.steps(), []
    t, _, n = steps.shape
    size = net.state.shape[1]
    states = _states(net, steps, keep)
    chances = _chances(net, states, windows)
    own = windows.own()
    share = own / max(own.sum(), 1)
    loss = -float((np.log(np.maximum(chances[:, np.arange(n), language], 1e-30)) * share).sum())
    wrong = chances
    wrong[:, np.arange(n), language] -= 1
    wrong *= share[:, :, None].astype(np.float32)
    other = np.zeros_like(wrong)
    np.put_along_axis(other, windows.partner()[:, :, None], np.where(own[:, :, None], wrong, 0), axis=0)
    # A step beyond a window's end shares partner 0, which belongs to its last byte; set that one again.
    last = (windows.end - windows.start - 1)[None, :, None]
    other[0] = np.take_along_axis(wrong, last, axis=0)[0]
    errors = np.stack([wrong, other], axis=1)
    out = np.einsum("tdnh,tdnc->dhc", states[1:], errors)
    down = np.einsum("tdnc,dhc->tdnh", errors, net.out)
    state, byte = np.zeros_like(net.state), np.empty((t, 2, n, 3 * size), np.float32)
    turned, back = net.state.transpose(0, 2, 1), np.zeros((2, n, size), np.float32)
    for i in range(t - 1, -1, -1):
        h, (z, r, fresh, mine) = states[i], keep[i]
        error = down[i] + back
        d_fresh = error * (1 - z) * (1 - fresh * fresh)
        through = byte[i]
        through[..., :size] = error * (h - fresh) * z * (1 - z)
        through[..., size:2 * size] = d_fresh * mine * r * (1 - r)
        through[..., 2 * size:] = d_fresh * r
        state += h.transpose(0, 2, 1) @ through
        back = error * z + through @ turned
        through[..., 2 * size:] = d_fresh
    table = np.zeros_like(net.byte)
    flat = steps.ravel()
    order = np.argsort(flat, kind="stable")
    used, starts = np.unique(flat[order], return_index=True)
    table[used] = np.add.reduceat(byte.reshape(-1, 3 * size)[order], starts, axis=0)
    return loss, [table, state, out, wrong.sum(axis=(0, 1))]


def trained_on(net: Network, windows: Windows, language: np.ndarray, epochs: int, seed: int, rate: float = 0.01, batch: int = 64) -> Network:
    """The network after *epochs* over the windows (Adam, gradients cut to length one)."""
    drawn = np.random.default_rng(seed)
    weights = [w.astype(np.float32) for w in net.weights()]
    means, squares = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    done = 0
    for _ in range(epochs):
        order = drawn.permutation(len(language))
        for at in range(0, len(order), batch):
            some = order[at:at + batch]
            _, found = gradients(Network(*weights), windows.take(some), language[some])
            length = np.sqrt(sum(float((g * g).sum()) for g in found))
            done += 1
            for w, g, m, s in zip(weights, found, means, squares):
                g = g / max(length, 1.0)
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                w -= rate * (m / (1 - 0.9**done)) / (np.sqrt(s / (1 - 0.99**done)) + 1e-8)
    return Network(*weights)


def _one_round(net: Network, number: int, epochs: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
        if not pieces:
            return
        pieces.sort()
        data, bounds = _joined([p for _, p, _ in pieces])
        windows, row = Windows.cut(data, bounds, PIECE, 0)
        language = np.array([x for *_, x in pieces])[row]
        better = trained_on(net, windows, language, epochs, SEED + number)
        yield pa.RecordBatch.from_arrays(
            [pa.array([better.flat().tolist()], pa.list_(pa.float32())), pa.array([len(pieces)], pa.int64())], ["weights", "n"]
        )

    return rows


def _pieces(text: Column) -> Column:
    """Evenly spaced stretches of the text's bytes."""

    @F.arrow_udf("array<binary>")
    def cut(batch: pa.Array) -> pa.Array:
        rows = []
        for text in batch:
            data = text.as_py().encode("utf-8", "replace")
            room = max(len(data) - PIECE, 0)
            starts = sorted({room * (2 * i + 1) // (2 * PIECES) for i in range(PIECES)})
            rows.append([data[s:s + PIECE] for s in starts])
        return pa.array(rows, pa.list_(pa.binary()))

    return cut(text)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


@dataclass(frozen=True)
class Model:
    network: Network
    languages: list[str]

    def predicted(self, text: Column) -> Column:
        """``struct<lang, score>`` of each text; of texts without letters, ``und`` and 0."""
        network, languages = self.network, self.languages

        @F.arrow_udf("struct<lang:string,score:double>")
        def answer(batch: pa.Array) -> pa.Array:
            names, scores, texts, size = [], [], [], 0

            def flush() -> None:
                chances = pooled(network, *_joined(texts))
                best = chances.argmax(axis=1)
                names.extend(languages[b] for b in best.tolist())
                scores.extend(np.clip(chances[np.arange(len(best)), best], 0, 1).tolist())

            for text in batch:
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= _BYTES_AT_ONCE:
                    flush()
                    texts, size = [], 0
            if texts:
                flush()
            return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

        lettered = has_letter(text)
        found = answer(F.when(lettered, text).otherwise(F.lit("")))
        none = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
        return F.when(lettered, found).otherwise(none)


def fit(labelled: DataFrame, per_language: int = 1500, hidden: int = HIDDEN, epochs: int = 4, seed: int = SEED) -> Model | None:
    """A model of ``doc_id, text, lang`` rows, or None if none of them has a language and a letter."""
    usable = labelled.where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    counts = settle(usable.groupBy("lang").agg(F.count("*").alias("known")))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")), F.lit(1 << 30))
    # The table of languages has a known size, so the join takes no shuffle unless there are very many of them.
    kept = usable.join(counts, "lang").where(drawn < F.lit(float(per_language << 30)) / F.col("known"))
    pieces = settle(
        kept.select("lang", drawn.alias("drawn"), F.explode(_pieces(F.col("text"))).alias("piece")).where(F.octet_length("piece") > 0)
    )
    languages = [row["lang"] for row in pieces.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        return None
    number = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1
    rows = settle(pieces.select("drawn", "piece", number.alias("language")).repartition(REPLICAS, F.xxhash64("drawn", "piece")))
    network = Network.drawn(len(languages), hidden, seed)
    for i in range(ROUNDS):
        found = rows.repartition(REPLICAS, F.xxhash64("drawn", "piece")).mapInArrow(
            _one_round(network, i, epochs), "weights array<float>, n long"
        ).collect()
        found = sorted((row["n"], row["weights"]) for row in found)
        network = network.like(np.average([w for _, w in found], axis=0, weights=[n for n, _ in found]))
    return Model(network, languages)


def held_out(doc_id: Column) -> Column:
    """Whether a document's language is kept for checking: one in four, by checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identified(documents: DataFrame, **settings: object) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: one row per document."""
    model = fit(documents.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), **settings)
    if model is None:
        found = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    else:
        found = model.predicted(whole_text())
    told = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), found.alias("found"))
    return told.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
