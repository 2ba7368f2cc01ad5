"""Secret scan: fixed patterns, and a character network over every further candidate.

Fixed patterns give the base findings, which always stay. Every other long token that mixes in digits is a candidate. A
convolutional network in numpy reads a candidate whole, with the text around it; it is trained on all labelled
findings: base findings are secrets, candidates of known harmless forms (numbers, addresses, failing matches of the fixed
patterns) are not, and the rest carries no label. Training windows appear as they are, without context or in the context of others,
so that the network does not lean on the patterns' key words. Its output is calibrated on rows held back, in all three
forms, and the threshold is the highest that keeps ``RECALL`` of the held-back secrets.

Texts are searched once; candidates with their windows are written, learnt from and scored from there. Labelled windows
alone are shuffled: each distinct one falls into a shard by its checksum. In a round every shard passes once over its
windows, starting from the same parameters, and the next round starts from their mean. The held-back outputs are counted in
steps of ``STEP``, so that calibration and threshold rest on all of them.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterstone.llm.tables import text_of
from meterstone.session import through_table

# The patterns of the base findings.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "model")
ASSIGN_CHARS, ACCESS_CHARS = 8, 16

#: Further candidates: whole runs of these characters, at least 12, with a digit among them.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.@-])(?=[A-Za-z+/_=.@-]*[0-9])[A-Za-z0-9+/_=.@-]{12,}")
HARMLESS = re.compile(r"[0-9.,:/+-]+|[^@]+@[^@]+|[0-9]*[A-Za-z.-]+[0-9]{0,2}\.?")
LEFT, RIGHT = 24, 16

#: Distinct labelled windows of a shard and their characters, on average.
SHARD_ROWS, SHARD_CHARS = 4096, 1 << 20
#: Windows of any length are learnt from and judged, longer ones in pieces of this size.
PIECE = 4096
HELD_BACK = 0.3
RECALL = 0.99
#: Outputs of the network between plus and minus ``MOST`` are counted in such steps.
STEP, MOST = 0.001, 30
SYMBOLS, WIDTH, KERNEL, FILTERS, EPOCHS, RATE = 40, 8, 5, 16, 8, 0.01


def base_findings(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points; matches of one kind do not overlap, failing ones are used up all the same."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def _window(text: str, a: int, b: int) -> str:
    left, right = (t.replace("\0", " ") for t in (text[max(0, a - LEFT) : a], text[b : b + RIGHT]))
    return f"{left}\0{text[a:b]}\0{right}"


class _Taken:
    """Spans in the order of their starts, asked for overlaps with spans that come in order of their starts as well."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.spans, self.at, self.reach = list(spans), 0, 0

    def meets(self, a: int, b: int) -> bool:
        # Whatever starts before b has been seen; of that, only how far it reaches matters.
        while self.at < len(self.spans) and self.spans[self.at][0] < b:
            self.reach = max(self.reach, self.spans[self.at][1])
            self.at += 1
        return self.reach > a


def findings(text: str) -> list[tuple[str, int, int, int, str]]:
    """Base findings (label 1) and candidates beside them (0: harmless form, -1: no label) with their windows."""
    base = base_findings(text)
    out = [(kind, a, b, 1) for kind, a, b in base]
    values = {m.start(): m.span(2) for m in ASSIGN.finditer(text)}
    taken = _Taken((a, b) for _, a, b in base)
    beside = [("model", *m.span(), 0 if HARMLESS.fullmatch(m[0]) else -1) for m in CANDIDATE.finditer(text) if not taken.meets(*m.span())]
    out += beside
    taken, more = _Taken((a, b) for _, a, b in base), _Taken((a, b) for _, a, b, _ in beside)
    for a, (c, d) in values.items():
        if d - c < ASSIGN_CHARS and not taken.meets(a, d) and not more.meets(a, d):
            out.append(("model", a, d, 0))
    out.sort(key=lambda f: (f[1], KINDS.index(f[0])))
    # Of an assignment the network judges the value; the name before it is context.
    shown = [values[a] if kind == "assign" or (a in values and label == 0) else (a, b) for kind, a, b, label in out]
    return [(*f, _window(text, *span)) for f, span in zip(out, shown, strict=True)]


_ITEM = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("label", pa.int32()), ("window", pa.string())])
_ITEMS = "items array<struct<kind string, start int, end int, label int, window string>>"


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, items), one row per row of ``docs(doc_id, text)``; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = []
            for text in batch.column("text"):
                found = findings(text.as_py())
                items.append([dict(zip(("kind", "start", "end", "label", "window"), f, strict=True)) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(items, pa.list_(_ITEM))], names=["doc_id", "items"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {_ITEMS}")


# The network


def _symbols() -> np.ndarray:
    """Symbol of each character below 128: letters by case and half, hex digits apart, digits, marks."""
    table = np.ones(129, np.uint8)
    for k, group in enumerate(("\0", "abcdef", "ghijklm", "nopqrst", "uvwxyz", "ABCDEF", "GHIJKLM", "NOPQRST", "UVWXYZ", "01234", "56789", " ", "\t\r\n", *"+/_.=-@:\"',;!#$%&*(){}<>"), 2):
        for c in group:
            table[ord(c)] = min(k, SYMBOLS - 1)
    return table


_SYMBOL = _symbols()


def coded(windows: list[str]) -> list[tuple[np.ndarray, int, int]]:
    """Symbols of each window without the separators, and where the candidate stands."""
    out = []
    for window in windows:
        left, inside, right = window.split("\0", 1)[0], *window.split("\0", 1)[1].rsplit("\0", 1)
        points = np.frombuffer((left + inside + right).encode("utf-32-le"), np.uint32)
        out.append((_SYMBOL[np.minimum(points, 128)], len(left), len(left) + len(inside)))
    return out


def _batch(rows: list[tuple[np.ndarray, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded symbols, and masks of candidate and context positions."""
    size = max(max(len(r[0]) for r in rows), KERNEL)
    x, inside, around = np.zeros((len(rows), size), np.int64), np.zeros((len(rows), size), bool), np.zeros((len(rows), size), bool)
    for k, (s, a, b) in enumerate(rows):
        x[k, : len(s)] = s
        inside[k, a:b] = True
        around[k, :a], around[k, b : len(s)] = True, True
    return x, inside, around


def _pieces(x: np.ndarray, a: int, b: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first place, symbols, masks) piece by piece of one long row; neighbours of a piece are read with it but not pooled."""
    half = KERNEL // 2
    for at in range(0, len(x), PIECE):
        lo, hi = max(0, at - half), min(len(x), at + PIECE + half)
        place = np.arange(lo, hi)
        own = (place >= at) & (place < at + PIECE)
        within = (place >= a) & (place < b)
        yield lo, x[None, lo:hi], (own & within)[None], (own & ~within)[None]


_SHAPES = [(SYMBOLS, WIDTH), (KERNEL * WIDTH, FILTERS), (FILTERS,), (3 * FILTERS + 1, 1), (1,)]


@dataclass
class Network:
    """Embedding, one convolution, the largest and the mean answer inside the candidate, the largest around it, its length."""

    parameters: list[np.ndarray]
    line: tuple[float, float] = (1.0, 0.0)
    threshold: float = 1.1

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        return cls([rng.normal(0, 0.3, s) if len(s) > 1 else np.zeros(s) for s in _SHAPES])

    def forward(self, x: np.ndarray, inside: np.ndarray, around: np.ndarray):
        table, kernel, bias, out, shift = self.parameters
        half = KERNEL // 2
        padded = np.pad(x, ((0, 0), (half, half)))
        spread = np.concatenate([table[padded[:, k : k + x.shape[1]]] for k in range(KERNEL)], axis=2)
        hidden = np.maximum(spread @ kernel + bias, 0)
        n = np.maximum(inside.sum(axis=1), 1)[:, None]
        best = np.where(inside[:, :, None], hidden, 0)
        near = np.where(around[:, :, None], hidden, 0)
        pooled = np.hstack([best.max(axis=1), best.sum(axis=1) / n, near.max(axis=1), np.log(n) / 2])
        return pooled @ out[:, 0] + shift[0], (padded, spread, hidden, best, near, n, pooled)

    def gradient(self, rows: list[tuple[np.ndarray, int, int]], y: np.ndarray) -> list[np.ndarray]:
        """Of the mean loss; rows share padded batches of bounded size, and long ones are read piece by piece."""
        out = [np.zeros_like(p) for p in self.parameters]
        short = [k for k, r in enumerate(rows) if len(r[0]) <= PIECE]
        many = (1 << 16) // max([KERNEL, *(len(rows[k][0]) for k in short)])
        for at in range(0, len(short), many):
            part = short[at : at + many]
            self._add_batch(out, *_batch([rows[k] for k in part]), y[part], len(y))
        for k, r in enumerate(rows):
            if len(r[0]) > PIECE:
                self._add_long(out, *r, y[k], len(y))
        return out

    def _add_batch(self, sums: list[np.ndarray], x: np.ndarray, inside: np.ndarray, around: np.ndarray, y: np.ndarray, many: int) -> None:
        out = self.parameters[3]
        logit, cache = self.forward(x, inside, around)
        best, near, n, pooled = cache[3:]
        d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / many
        d_pooled = d[:, None] * out[:, 0]
        d_hidden = inside[:, :, None] * (d_pooled[:, FILTERS : 2 * FILTERS] / n)[:, None, :]
        for part, mask, grad in ((best, inside, d_pooled[:, :FILTERS]), (near, around, d_pooled[:, 2 * FILTERS : 3 * FILTERS])):
            at = part.argmax(axis=1)
            rows, cols = np.indices(at.shape)
            d_hidden[rows, at, cols] += grad * mask[rows, at]
        self._add_below(sums, x, cache, d_hidden)
        sums[3] += pooled.T @ d[:, None]
        sums[4] += d.sum()

    def _add_below(self, sums: list[np.ndarray], x: np.ndarray, cache: tuple, d_hidden: np.ndarray) -> None:
        padded, spread, hidden = cache[:3]
        d_hidden *= hidden > 0
        d_spread = d_hidden @ self.parameters[1].T
        d_symbol = np.zeros((*padded.shape, WIDTH))
        for k in range(KERNEL):
            d_symbol[:, k : k + x.shape[1]] += d_spread[:, :, k * WIDTH : (k + 1) * WIDTH]
        slots = padded.astype(np.int64)[:, :, None] * WIDTH + np.arange(WIDTH)
        sums[0] += np.bincount(slots.ravel(), d_symbol.ravel(), minlength=sums[0].size).reshape(sums[0].shape)
        sums[1] += spread.reshape(-1, spread.shape[2]).T @ d_hidden.reshape(-1, FILTERS)
        sums[2] += d_hidden.sum(axis=(0, 1))

    def _add_long(self, sums: list[np.ndarray], x: np.ndarray, a: int, b: int, y: float, many: int) -> None:
        pooled, tops = self._pooled(x, a, b)
        logit = pooled @ self.parameters[3][:, 0] + self.parameters[4][0]
        d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / many
        d_pooled = d * self.parameters[3][:, 0]
        for lo, part, inside, around in _pieces(x, a, b):
            cache = self.forward(part, inside, around)[1]
            d_hidden = inside[:, :, None] * (d_pooled[FILTERS : 2 * FILTERS] / max(b - a, 1))
            for top, mask, grad in ((tops[0], inside, d_pooled[:FILTERS]), (tops[1], around, d_pooled[2 * FILTERS : 3 * FILTERS])):
                here = np.flatnonzero((top >= lo) & (top < lo + part.shape[1]))
                here = here[mask[0, top[here] - lo]]
                d_hidden[0, top[here] - lo, here] += grad[here]
            self._add_below(sums, part, cache, d_hidden)
        sums[3] += pooled[:, None] * d
        sums[4] += d

    def _pooled(self, x: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """What is pooled over one long row, and where the largest answers inside and around the candidate stand (-1: nowhere)."""
        best, total, near = np.zeros(FILTERS), np.zeros(FILTERS), np.zeros(FILTERS)
        tops = np.full((2, FILTERS), -1)
        for lo, part, inside, around in _pieces(x, a, b):
            cache = self.forward(part, inside, around)[1]
            for most, top, found in ((best, tops[0], cache[3][0]), (near, tops[1], cache[4][0])):
                larger = found.max(axis=0) > most
                top[larger] = lo + found.argmax(axis=0)[larger]
                most[larger] = found.max(axis=0)[larger]
            total += cache[3].sum(axis=(0, 1))
        n = max(b - a, 1)
        return np.concatenate([best, total / n, near, [np.log(n) / 2]]), tops

    def _long(self, x: np.ndarray, a: int, b: int) -> float:
        return float(self._pooled(x, a, b)[0] @ self.parameters[3][:, 0] + self.parameters[4][0])

    def logits(self, rows: list[tuple[np.ndarray, int, int]]) -> np.ndarray:
        """Of candidates of any length; those of similar length share a padded batch."""
        out = np.zeros(len(rows))
        order = sorted(range(len(rows)), key=lambda k: len(rows[k][0]))
        at = 0
        for k in order:
            if len(rows[k][0]) > PIECE:
                out[k] = self._long(*rows[k])
        order = [k for k in order if len(rows[k][0]) <= PIECE]
        while at < len(order):
            size = max(KERNEL, len(rows[order[min(at + 255, len(order) - 1)]][0]))
            many = max(1, min(256, (1 << 16) // size))
            part = order[at : at + many]
            out[part] = self.forward(*_batch([rows[k] for k in part]))[0]
            at += many
        return out

    def probabilities(self, windows: list[str]) -> np.ndarray:
        return self._probability(np.clip(self.logits(coded(windows)), -MOST, MOST))

    def _probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.line[0] * logit + self.line[1], -30, 30)))


def _calibration(logit: np.ndarray, y: np.ndarray, times: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the line that makes the logits probabilities, by Newton steps with a light ridge."""
    w, z = np.array([1.0, 0.0]), np.column_stack([logit, np.ones(len(logit))])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        curve = (z * (times * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + 0.1 * np.eye(2)
        w = w - np.linalg.solve(curve, z.T @ (times * (p - y)) + 0.1 * (w - [1.0, 0.0]))
    return float(max(w[0], 1e-3)), float(w[1])


def _views(rows: list[tuple[np.ndarray, int, int]], rng: np.random.Generator) -> list[list[tuple[np.ndarray, int, int]]]:
    """The rows as they are, without context, and each in the context of another row."""
    bare = [(s[a:b], 0, b - a) for s, a, b in rows]
    others = [rows[k] for k in rng.permutation(len(rows))]
    moved = [(np.concatenate([t[:c], s[a:b], t[d:]]), c, c + b - a) for (s, a, b), (t, c, d) in zip(rows, others, strict=True)]
    return [rows, bare, moved]


def _is_held(window: str) -> bool:
    return zlib.crc32(window.encode()) % 1000 < 1000 * HELD_BACK


def _state(*groups: list[np.ndarray], step: float) -> np.ndarray:
    """Parameters, both moments and the number of steps as one vector, so that shards can be averaged."""
    return np.concatenate([*(p.ravel() for group in groups for p in group), [step]])


def _groups(state: np.ndarray) -> list[list[np.ndarray]]:
    ends = np.cumsum([math.prod(s) for s in _SHAPES] * 3)
    parts = [p.reshape(s).copy() for p, s in zip(np.split(state[:-1], ends[:-1]), _SHAPES * 3, strict=True)]
    return [parts[k : k + len(_SHAPES)] for k in range(0, len(parts), len(_SHAPES))]


def _start(seed: int) -> np.ndarray:
    fresh, none = Network.fresh(seed).parameters, [np.zeros(s) for s in _SHAPES]
    return _state(fresh, none, none, step=0)


def _epoch(state: np.ndarray, windows: list[str], labels: list[int], seed: tuple[int, ...]) -> np.ndarray:
    """The state after one pass over the windows, in small shuffled batches of similar length."""
    rng = np.random.default_rng(seed)
    parameters, first, second = _groups(state)
    network, step = Network(parameters), float(state[-1])
    rows, y = coded(windows), np.array(labels, float)
    used = rng.permutation(len(rows))
    for block in sorted((used[k : k + 512] for k in range(0, len(used), 512)), key=len):
        block = sorted(block, key=lambda k: len(rows[k][0]))
        for at in range(0, len(block), 32):
            views = _views([rows[k] for k in block[at : at + 32]], rng)
            part = [views[v][k] for k, v in enumerate(rng.integers(0, 3, len(views[0])))]
            step += 1
            for k, g in enumerate(network.gradient(part, y[block[at : at + 32]])):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                moved = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                parameters[k] -= RATE * moved
    return _state(parameters, first, second, step=step)


def _steps(state: np.ndarray, windows: list[str], labels: list[int], seed: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, step, times) of the network's outputs for the windows in all three forms; an output counts as the step below it."""
    network = Network(_groups(state)[0])
    logit = np.concatenate([network.logits(view) for view in _views(coded(windows), np.random.default_rng(seed))])
    step = np.floor(np.clip(logit, -MOST, MOST) / STEP).astype(np.int64)
    (label, step), times = np.unique([np.tile(np.array(labels, np.int64), 3), step], axis=1, return_counts=True)
    return label, step, times


def _fitted(state: np.ndarray, label: np.ndarray, step: np.ndarray, times: np.ndarray) -> Network:
    """The network with its calibration and threshold from all held-back outputs."""
    order = np.lexsort((label, step))
    label, logit, times = label[order], step[order] * STEP, times[order]
    network = Network(_groups(state)[0], _calibration(logit, label, times))
    good = label == 1
    most = int((1 - RECALL) * times[good].sum())
    lowest = logit[good][np.searchsorted(np.cumsum(times[good]), most, side="right")]
    network.threshold = float(network._probability(lowest))
    return network


def train(windows: list[str], labels: list[int], seed: int = 7) -> Network | None:
    """Fit, calibrate and set the threshold on one shard; None unless both parts hold both labels."""
    rows = sorted(zip(labels, windows, strict=True))
    held, used = ([(w, y) for y, w in rows if _is_held(w) == part] for part in (True, False))
    if min(len({y for _, y in part}) for part in (held, used)) < 2:
        return None
    state = _start(seed)
    for epoch in range(EPOCHS):
        state = _epoch(state, [w for w, _ in used], [y for _, y in used], (seed, epoch, 0))
    return _fitted(state, *_steps(state, [w for w, _ in held], [y for _, y in held], (seed, EPOCHS, 0)))


def labelled(found: DataFrame) -> DataFrame:
    """(shard, held, rows(label, window)): every distinct labelled window, in written shards."""
    items = found.select(F.explode("items").alias("i")).select("i.label", "i.window").filter("label >= 0")
    rows = through_table(items.distinct(), "labelled")
    many, chars = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.char_length("window")), F.lit(0))).first()
    shards = 1 + max(many // SHARD_ROWS, chars // SHARD_CHARS)
    check = F.crc32(F.col("window").cast("binary"))
    # The checksum's low digits tell what is held back, the others the shard.
    dealt = rows.select(F.floor(check / 1000) % shards, check % 1000 < int(1000 * HELD_BACK), F.struct("label", "window")).toDF("shard", "held", "row")
    shard = dealt.repartition(shards, "shard").groupBy("shard", "held").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return through_table(shard, "shards")


def _of_shards(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[str]]]:
    """(shard, labels, windows) one by one."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            yield row["shard"], [r["label"] for r in row["rows"]], [r["window"] for r in row["rows"]]


def _round(shards: DataFrame, state: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """The mean of the states after a pass over each shard, weighted by their windows; sums are decimal, so their order is of no account."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, labels, windows in _of_shards(batches):
            after = _epoch(state, windows, labels, (*seed, shard))
            yield pa.RecordBatch.from_arrays([pa.array([len(windows)], pa.int64()), pa.array([after.tolist()], pa.list_(pa.float64()))], names=["n", "state"])

    parts = shards.select("shard", "rows").mapInArrow(run, "n long, state array<double>").select("n", F.posexplode("state").alias("k", "v"))
    total = F.sum((F.col("v") * F.col("n")).cast("decimal(38,18)")).cast("double")
    means = parts.groupBy("k").agg((total / F.sum("n")).alias("v")).collect()
    return np.array([r.v for r in sorted(means)])


def fitted(found: DataFrame, seed: int = 7) -> Network | None:
    """``train`` over every labelled finding; only means over the shards and counts of output steps reach the driver."""
    shards = labelled(found)
    kinds = shards.select("held", F.explode("rows.label").alias("label")).distinct().count()
    if kinds < 4:
        return None
    state = _start(seed)
    for epoch in range(EPOCHS):
        state = _round(shards.filter("not held"), state, (seed, epoch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, labels, windows in _of_shards(batches):
            parts = _steps(state, windows, labels, (seed, EPOCHS, shard))
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()) for p in parts], names=["label", "step", "times"])

    steps = shards.filter("held").select("shard", "rows").mapInArrow(run, "label long, step long, times long")
    counts = steps.groupBy("label", "step").agg(F.sum("times").alias("times")).toArrow()
    return _fitted(state, *(counts.column(c).to_numpy() for c in ("label", "step", "times")))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans), one row per row of ``docs(doc_id, text)``: structs (kind, start, end, probability) by start, then kind.

    Base findings have kind assign, access or hex, findings of the network alone kind model; positions are code points, the
    end exclusive. Null text is empty; repeated rows are searched each by itself; where no labelled findings of both kinds
    exist, only base findings return. An empty table gives no rows; further columns are ignored.
    """
    found = through_table(candidates(docs), "findings")
    network = fitted(found)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("items").to_pylist()
            flat = [i for items in rows for i in items]
            p = network.probabilities([i["window"] for i in flat]) if network and flat else np.ones(len(flat))
            least = network.threshold if network else 1.1
            spans, at = [], 0
            for items in rows:
                scored = [(i, float(p[at + k])) for k, i in enumerate(items)]
                at += len(items)
                spans.append([{"kind": i["kind"], "start": i["start"], "end": i["end"], "probability": round(q, 6)} for i, q in scored if i["label"] == 1 or q >= least])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(kind))], names=["doc_id", "spans"])

    return found.mapInArrow(run, "doc_id long, spans array<struct<kind string, start int, end int, probability double>>")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of the rows of ``scan``."""
    spans = F.col("spans")

    def number(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in KINDS]
    base = F.filter(spans, lambda s: s["kind"] != "model")
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))
