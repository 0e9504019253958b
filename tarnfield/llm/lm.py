"""Language-model scoring: masked pseudo-likelihood by a bidirectional window network over words.

Every word is predicted from the four words on either side. The targets are the OWN most frequent words and, for all other
words, groups by ending; within its group a word has its share of the group's words by its count in all other texts, so a
text is never scored by its own copies of a rare word. The softmax over targets is factored: a cluster, then a target in it.

The network is trained in numpy: from START texts on the driver, then from every word of all texts, each task going on from
there with all windows of its own texts, and the parameters are averaged by numbers of windows. Word counts are gathered from
all texts. Windows that follow each other share their inputs, so texts are laid in a line and each place's vector is read once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import ship, stash

#: Targets: words of their own and groups by ending, in clusters of equal size. The edge of a text is one more input.
OWN, ENDINGS, CLUSTERS = 1792, 256, 32
TARGETS = OWN + ENDINGS
EACH = TARGETS // CLUSTERS
EDGE = TARGETS
#: Of a target: its cluster, and its place in it.
CLUSTER, PLACE = (np.arange(TARGETS) // EACH).astype(np.uint8), np.arange(TARGETS) % EACH
SIDE, HIDDEN = 4, 32
#: Parameters changed at once.
IN_CACHE = 1 << 14
#: Texts (by hash of the text) that training starts from, windows in a step, and passes over the start.
START, BATCH, PASSES = 1000, 2048, 3
RATE = 0.08
#: Bytes of texts whose windows a task holds at once, and words scored in a step, which stays in a core's cache.
BYTES_AT_ONCE, SCORED = 1 << 20, 1 << 11
#: Where the inputs of a window stand, from its target.
PLACES = (*range(-SIDE, 0), *range(1, SIDE + 1))
#: The most frequent words, whose counts are broadcast. Those of all other words are joined.
VOCABULARY = 20_000
#: Bytes of texts that a task counts before it hands counts on, and endings kept for lookup.
COUNTED, HELD = 1 << 25, 200_000
#: A letter of a word that no other text has.
SPELLED = -float(np.log(26))
#: Joined log-probabilities are summed as whole numbers of this unit, so that the order of rows doesn't matter.
UNIT = 2**30
#: Parameters are averaged in so long pieces, and first by so many groups of tasks.
PIECE, GROUPS = 4096, 64


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def parted(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers of words of texts, and the words one after the other, as words() finds them."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = found.flatten().cast(pa.binary())
    some = pc.greater(pc.binary_length(flat), 0)  # white space at a text's ends parts empty words from others
    before = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False), dtype=np.int64)))
    ends = np.concatenate(([0], np.cumsum(found.value_lengths().to_numpy(), dtype=np.int64)))
    return np.diff(before[ends]), flat if before[-1] == len(flat) else flat.filter(some)


def portions(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts in turn, as many at once as have BYTES_AT_ONCE bytes, one at least; bounds the windows held."""
    ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + BYTES_AT_ONCE, "right")) - 1)
        yield texts.slice(lo, hi - lo)
        lo = hi


def ending(word: bytes) -> int:
    return OWN + zlib.crc32(word[-3:]) % ENDINGS


class Endings(dict):
    """Targets of last letters; looks up what it has not seen."""

    def __missing__(self, last: bytes) -> int:
        if len(self) > HELD:
            self.clear()
        self[last] = k = ending(last)
        return k


class Targets:
    """Targets of words: their own, or that of their ending."""

    def __init__(self, own: dict[bytes, int]) -> None:
        self.own, self.ends = own, Endings()
        self.words, self.numbers = pa.array(list(own), pa.binary()), np.fromiter(own.values(), np.int16, len(own))

    def ids(self, found: list[bytes]) -> list[int]:
        own, ends = self.own.get, self.ends
        return [k if (k := own(w)) is not None else ends[w[-3:]] for w in found]

    def of(self, found: pa.Array) -> np.ndarray:
        """The same of an array of words."""
        last = pc.binary_slice(found, -3, None).dictionary_encode()
        out = np.array([self.ends[x] for x in last.dictionary.to_pylist()], np.int16)[last.indices.to_numpy()]
        at = _places(found, self.words)
        out[at >= 0] = self.numbers[at[at >= 0]]
        return out

    def line(self, texts: pa.Array) -> np.ndarray:
        sizes, found = parted(texts)
        found = found.dictionary_encode()
        return laid(sizes, self.of(found.dictionary)[found.indices.to_numpy()])


def _places(found: pa.Array, among: pa.Array) -> np.ndarray:
    """Where words stand among others, -1 for those that don't."""
    return pc.fill_null(pc.index_in(found, value_set=among), -1).to_numpy()


class Network(NamedTuple):
    embed: np.ndarray  #: (input, hidden)
    gain: np.ndarray  #: (place in the window, hidden)
    bias: np.ndarray
    cluster: np.ndarray  #: (hidden, cluster)
    cluster_bias: np.ndarray
    inside: np.ndarray  #: (cluster, hidden, target in it)
    inside_bias: np.ndarray  #: (cluster, target in it)

    def copy(self) -> Network:
        return Network(*(x.copy() for x in self))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self])

    def filled(self, values: np.ndarray) -> Network:
        cuts = np.cumsum([x.size for x in self])[:-1]
        return Network(*(v.reshape(x.shape).astype(np.float32) for v, x in zip(np.split(values, cuts), self, strict=True)))


class Layers(NamedTuple):
    """A network as steps along lines use it: by hidden unit, so that a row is a line, with biases as one more row of weights."""

    embed: np.ndarray  #: (hidden, input)
    taps: np.ndarray  #: (hidden, place from SIDE before the target to SIDE after it): gains, 0 at the target
    bias: np.ndarray  #: (hidden, 1)
    cluster: np.ndarray  #: (hidden and bias, cluster)
    inside: np.ndarray  #: (cluster, hidden and bias, target in it)

    @staticmethod
    def over(flat: np.ndarray) -> Layers:
        """Views of one array that holds all parameters."""
        shapes = ((HIDDEN, TARGETS + 1), (HIDDEN, 2 * SIDE + 1), (HIDDEN, 1), (HIDDEN + 1, CLUSTERS), (CLUSTERS, HIDDEN + 1, EACH))
        cuts = np.cumsum([np.prod(x) for x in shapes])[:-1]
        return Layers(*(v.reshape(x) for v, x in zip(np.split(flat, cuts), shapes, strict=True)))

    @staticmethod
    def flat(net: Network) -> np.ndarray:
        taps = np.insert(net.gain, SIDE, 0, axis=0).T
        return np.concatenate([x.ravel() for x in (net.embed.T, taps, net.bias, net.cluster, net.cluster_bias, np.concatenate((net.inside, net.inside_bias[:, None]), axis=1))])

    def put(self, net: Network) -> None:
        """Into a network in place."""
        parts = (self.embed.T, np.delete(self.taps, SIDE, axis=1).T, self.bias[:, 0], self.cluster[:-1], self.cluster[-1], self.inside[:, :-1], self.inside[:, -1])
        for to, x in zip(net, parts, strict=True):
            to[...] = x


class Model(NamedTuple):
    own: dict[bytes, int]
    network: Network
    counts: dict[bytes, int]  #: of frequent words
    totals: np.ndarray  #: of words by target
    others: DataFrame | None  #: word, n of the other counted words


def fresh(totals: np.ndarray, seed: int = 7) -> Network:
    """A network that knows the targets' shares only."""
    rng = np.random.default_rng(seed)
    n = totals.reshape(CLUSTERS, EACH) + 1.0
    normal = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return Network(normal(TARGETS + 1, HIDDEN), np.ones((2 * SIDE, HIDDEN), np.float32), np.zeros(HIDDEN, np.float32), normal(HIDDEN, CLUSTERS) * 0.1, np.log(n.sum(axis=1) / n.sum()).astype(np.float32), normal(CLUSTERS, HIDDEN, EACH) * 0.1, np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32))


def line(texts: list[list[int]]) -> np.ndarray:
    """Targets of texts one after the other; SIDE EDGEs before, between and after them."""
    pad = [EDGE] * SIDE
    flat = list(pad)
    for t in texts:
        flat += t
        flat += pad
    return np.array(flat, np.int16)


def laid(sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The line of texts of such sizes from their targets one after the other."""
    out = np.full(len(ids) + SIDE * (len(sizes) + 1), EDGE, np.int16)
    out[np.arange(len(ids)) + SIDE * np.repeat(np.arange(1, len(sizes) + 1), sizes)] = ids
    return out


def pieces(ids: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of a line with so many targets (the last has what is left), and where in a piece they stand. The first and the
    last SIDE places of a line or piece are inputs only."""
    at = SIDE + np.flatnonzero(ids[SIDE:-SIDE] != EDGE)
    for lo in range(0, len(at), size):
        part = at[lo : lo + size]
        first = part[0] - SIDE
        yield ids[first : part[-1] + SIDE + 1], part - first


def windows(texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (SIDE words before, then after) and target of each word; beyond a text's ends are EDGEs."""
    ids = line(texts)
    at = np.flatnonzero(ids != EDGE)
    return ids[at[:, None] + np.array(PLACES)].astype(np.int32), ids[at].astype(np.int32)


def _hidden(net: Network, inputs: np.ndarray) -> np.ndarray:
    x = np.broadcast_to(net.bias, (len(inputs), HIDDEN)).copy()
    for j in range(2 * SIDE):
        x += net.embed[inputs[:, j]] * net.gain[j]
    return np.tanh(x, out=x)


def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(z) but for a factor a row, in place of z, and the sums of rows."""
    z = _small(z)
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], z.dtype)


def _small(z: np.ndarray) -> np.ndarray:
    """z, less the largest of each row if sums of exp(z) could leave the range of floats."""
    if max(z.max(initial=0), -z.min(initial=0)) > 80:
        z -= z.max(axis=1, keepdims=True)
    return z


def _by_cluster(targets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order by cluster, and (cluster, from, to) in it of clusters that occur."""
    cluster = CLUSTER[targets]  # sorted by counting
    ends = np.cumsum(np.bincount(cluster, minlength=CLUSTERS)).tolist()
    return np.argsort(cluster, kind="stable"), [(c, lo, hi) for c, (lo, hi) in enumerate(zip([0, *ends], ends, strict=False)) if lo < hi]


def _inside(net: Network, h: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Scores of the targets of each row's cluster; rows in order of clusters."""
    z = np.empty((len(h), EACH), np.float32)
    for c, lo, hi in runs:
        part = np.matmul(h[lo:hi], net.inside[c], out=z[lo:hi])
        part += net.inside_bias[c]
    return z


def _of_targets(net: Network, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Log-probability of each row's target."""
    rows = np.arange(len(targets))
    order, runs = _by_cluster(targets)
    out = np.empty(len(targets), np.float64)
    for z, at, k in ((h @ net.cluster + net.cluster_bias, rows, targets // EACH), (_inside(net, h[order], runs), order, targets[order] % EACH)):
        own = _small(z)[rows, k]
        own -= np.log(_exp(z)[1])
        if at is rows:
            out[:] = own
        else:
            out[at] += own
    return out


def log_probabilities(net: Network, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Of each target given its window."""
    steps = range(0, len(targets), SCORED)
    return np.concatenate([_of_targets(net, _hidden(net, inputs[lo : lo + SCORED]), targets[lo : lo + SCORED]) for lo in steps] or [np.zeros(0)])


def _hidden_along(layers: Layers, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all places of a piece, and the hidden layer at those that can be targets; a row for each hidden unit."""
    e = layers.embed.take(ids, axis=1, mode="clip")
    h = np.empty((HIDDEN, len(ids) - 2 * SIDE), np.float32)
    for to, row, taps in zip(h, e, layers.taps, strict=True):
        to[:] = np.correlate(row, taps, "valid")
    h += layers.bias
    return e, np.tanh(h, out=h)


def _scores_along(layers: Layers, h: np.ndarray, where: np.ndarray, runs: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of targets at those places of a hidden layer, in order of clusters: hidden units and a 1; scores of clusters; scores of
    the targets of their own cluster."""
    every = np.empty((h.shape[1], HIDDEN + 1), np.float32)
    every[:, :HIDDEN], every[:, HIDDEN] = h.T, 1
    x = every.take(where, axis=0, mode="clip")
    inside = np.empty((len(x), EACH), np.float32)
    for c, lo, hi in runs:
        np.matmul(x[lo:hi], layers.inside[c], out=inside[lo:hi])
    return x, _small(x @ layers.cluster), _small(inside)


def log_probabilities_along(net: Network, ids: np.ndarray) -> np.ndarray:
    """Of each target of a line given its window."""
    layers, out = Layers.over(Layers.flat(net)), [np.zeros(0)]
    for piece, at in pieces(ids.astype(np.intp), SCORED):
        targets = piece[at]
        order, runs = _by_cluster(targets)
        _, *scores = _scores_along(layers, _hidden_along(layers, piece)[1], (at - SIDE)[order], runs)
        part, targets = np.zeros(len(at)), targets[order]
        for z, k in zip(scores, (CLUSTER[targets], PLACE[targets]), strict=True):
            own = z.reshape(-1)[np.arange(len(z)) * z.shape[1] + k]
            part += own - np.log(_exp(z)[1])
        out.append(np.empty_like(part))
        out[-1][order] = part
    return np.concatenate(out)


def _back(net: Network, h: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Gradients of the mean negative log-probability: by the hidden layer before tanh, and by the layers above it."""
    n = len(targets)
    order, runs = _by_cluster(targets)
    rows, h, targets = np.arange(n), h[order], targets[order]
    dz, sums = _exp(h @ net.cluster + net.cluster_bias)
    dz *= (1 / (n * sums))[:, None]
    dz[rows, targets // EACH] -= 1 / n
    dh = dz @ net.cluster.T
    inside, inside_bias = np.zeros_like(net.inside), np.zeros_like(net.inside_bias)
    d, sums = _exp(_inside(net, h, runs))
    d *= (1 / (n * sums))[:, None]
    d[rows, targets % EACH] -= 1 / n
    inside_bias[[c for c, *_ in runs]] = np.add.reduceat(d, [lo for _, lo, _ in runs], axis=0)
    for c, lo, hi in runs:
        np.matmul(h[lo:hi].T, d[lo:hi], out=inside[c])
        dh[lo:hi] += d[lo:hi] @ net.inside[c].T
    dx = np.empty_like(dh)
    dx[order] = (1 - h * h) * dh
    return dx, (dx.sum(axis=0), h.T @ dz, dz.sum(axis=0), inside, inside_bias)


def _sums(where: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different places and the sums of their rows."""
    order = np.argsort(where.astype(np.int16), kind="stable")  # sorted by counting
    where = where[order]
    first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    return where[first], np.add.reduceat(values[order], first, axis=0)


def _descend(net: Network, seen: Network, rows: np.ndarray, embed: np.ndarray, *others: np.ndarray) -> None:
    """Each parameter at a rate by the squares of its gradients so far (seen); embed: of those rows, the others' is 0."""
    s = seen.embed[rows] + embed * embed
    seen.embed[rows] = s
    net.embed[rows] -= RATE * embed / (np.sqrt(s) + 1e-6)
    for p, s, g in zip(net[1:], seen[1:], others, strict=True):
        s += g * g
        p -= RATE * g / (np.sqrt(s) + 1e-6)


def step(net: Network, seen: Network, inputs: np.ndarray, targets: np.ndarray) -> None:
    """One step of gradient descent on the mean negative log-probability of targets given their windows."""
    dx, above = _back(net, _hidden(net, inputs), targets)
    gain = np.stack([(dx * net.embed[inputs[:, j]]).sum(axis=0) for j in range(2 * SIDE)])
    _descend(net, seen, *_sums(inputs.T.ravel(), np.concatenate([dx * net.gain[j] for j in range(2 * SIDE)])), gain, *above)


def train_on(net: Network, seen: Network, inputs: np.ndarray, targets: np.ndarray) -> None:
    for lo in range(0, len(targets), BATCH):
        step(net, seen, inputs[lo : lo + BATCH], targets[lo : lo + BATCH])


class Along:
    """The same steps for the windows of pieces of lines; windows that follow each other share their inputs."""

    def __init__(self, net: Network, seen: Network) -> None:
        self.flat, self.seen = Layers.flat(net), Layers.flat(seen)
        self.gradient = np.zeros_like(self.flat)
        self.layers, self.by = Layers.over(self.flat), Layers.over(self.gradient)

    def step(self, ids: np.ndarray, at: np.ndarray) -> None:
        self._back(ids.astype(np.intp), at)
        free = np.empty(IN_CACHE, np.float32)
        for lo in range(0, len(self.flat), IN_CACHE):
            p, s, g = (x[lo : lo + IN_CACHE] for x in (self.flat, self.seen, self.gradient))
            part = free[: len(g)]
            s += np.multiply(g, g, out=part)
            np.sqrt(s, out=part)
            part += 1e-6
            np.divide(g, part, out=part)
            part *= RATE
            p -= part

    def put(self, net: Network, seen: Network) -> None:
        """What steps have made, into networks in place."""
        self.layers.put(net)
        Layers.over(self.seen).put(seen)

    def _back(self, ids: np.ndarray, at: np.ndarray) -> None:
        """Gradients of the mean negative log-probability, into self.by."""
        layers, by, n = self.layers, self.by, len(at)
        targets = ids[at]
        order, runs = _by_cluster(targets)
        targets, where = targets[order], (at - SIDE)[order]
        e, h = _hidden_along(layers, ids)
        x, *scores = _scores_along(layers, h, where, runs)
        for z, k in zip(scores, (CLUSTER[targets], PLACE[targets]), strict=True):
            _, sums = _exp(z)
            z.reshape(-1)[np.arange(n) * z.shape[1] + k] -= sums
            z *= (1 / (n * sums))[:, None]
        of_clusters, inside = scores
        np.matmul(x.T, of_clusters, out=by.cluster)
        if len(runs) < CLUSTERS:
            by.inside[:] = 0
        dh, part = of_clusters @ layers.cluster[:HIDDEN].T, np.empty((n, HIDDEN), np.float32)
        for c, lo, hi in runs:
            np.matmul(x[lo:hi].T, inside[lo:hi], out=by.inside[c])
            np.matmul(inside[lo:hi], layers.inside[c, :HIDDEN].T, out=part[lo:hi])
        dh += part
        every = np.zeros((h.shape[1], HIDDEN), np.float32)
        every[where] = dh
        np.multiply(h, h, out=h)
        dx = np.subtract(1, h, out=h)
        dx *= every.T
        by.bias[:, 0] = dx.sum(axis=1)
        by.embed[:] = 0
        for g, row, taps, to_taps, to_embed in zip(dx, e, layers.taps[:, ::-1], by.taps, by.embed, strict=True):
            to_taps[:] = np.correlate(row, g, "valid")
            np.add.at(to_embed, ids, np.correlate(g, taps, "full"))
        by.taps[:, SIDE] = 0


def train_along(net: Network, seen: Network, lines: Iterable[np.ndarray]) -> int:
    """Steps over every window of lines, BATCH at once; what a line leaves goes with the next. Returns their number."""
    n, rest, along = 0, line([]), Along(net, seen)
    for ids in lines:
        rest, whole = line([]), np.concatenate((rest, ids[SIDE:]))
        for piece, at in pieces(whole, BATCH):
            if len(at) < BATCH:
                rest = piece
            else:
                along.step(piece, at)
                n += BATCH
    for piece, at in pieces(rest, BATCH):
        along.step(piece, at)
        n += len(at)
    along.put(net, seen)
    return n


def _word_counts(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def told(held):
        found = pa.chunked_array(held, pa.binary()).value_counts()
        return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], schema=schema)

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for texts in portions(batch.column(0)):
                held.append(parted(texts)[1])
                size += held[-1].nbytes
                if size > COUNTED:
                    yield told(held)
                    held, size = [], 0
        if held:
            yield told(held)

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame) -> list[Row]:
    """The VOCABULARY most frequent words, ties to the lower word.

    Only counts from the step on that holds the last of them are sorted (steps are eighths of a power of two), so that the
    leaders of every task don't all come to the driver.
    """
    step = F.floor(F.log2("n") * 8)
    least, total = 0, 0
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():  # at most 512 rows
        least, total = r.step, total + r.words
        if total >= VOCABULARY:
            break
    return counts.where(step >= least).orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()


def _ending(word: Column) -> Column:
    return (OWN + F.crc32(F.substring(word, -3, 3)) % ENDINGS).cast("int")


def _totals(counts: DataFrame, top: list[tuple[bytes, int]]) -> np.ndarray:
    """Words of all texts by target."""
    out = np.zeros(TARGETS)
    for r in counts.groupBy(_ending(F.col("word")).alias("k")).agg(F.sum("n").alias("n")).collect():  # at most ENDINGS rows
        out[r.k] = r.n
    for k, (w, n) in enumerate(top[:OWN]):
        out[k] = n
        out[ending(w)] -= n
    return out


def _start(docs: DataFrame) -> list[str]:
    """START texts by the hash of the text; equal ones once."""
    texts = docs.where("text IS NOT NULL").select("text", F.xxhash64("text").alias("h"))
    return [r.text for r in texts.orderBy("h", "text").limit(START).collect()]


def _refined(docs: DataFrame, own: dict[bytes, int], net: Network, seen: Network) -> Network:
    """The mean, by windows, of what each task makes of a network with all windows of its texts."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((own, net, seen))  # bounded by TARGETS and HIDDEN
    kind = _parse_datatype_string("piece int, part int, n long, sums array<double>")
    arrow = to_arrow_schema(kind)

    def run(batches):
        own, net, seen = shared.value
        net, seen, targets = net.copy(), seen.copy(), Targets(own)
        n = train_along(net, seen, (targets.line(texts) for batch in batches for texts in portions(batch.column(0))))
        if n:
            flat = net.flat().astype(np.float64) * n
            cut = [flat[i : i + PIECE] for i in range(0, len(flat), PIECE)]
            part = zlib.crc32(flat.tobytes()) % GROUPS
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((range(len(cut)), [part] * len(cut), [n] * len(cut), [p.tolist() for p in cut]), arrow, strict=True)], schema=arrow)

    def add(table: pa.Table) -> pa.Table:
        sums = np.zeros(len(table.column("sums")[0]))
        for batch in table.to_batches():
            lists = batch.column("sums")
            sums += lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(sums)).sum(axis=0)
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip((table.column("piece")[0].as_py(), 0, sum(table.column("n").to_pylist()), sums.tolist()), arrow, strict=True)], schema=arrow)

    made = docs.select("text").mapInArrow(run, kind)
    for keys in (["piece", "part"], ["piece"]):
        made = made.groupBy(*keys).applyInArrow(add, kind)
    found = sorted(stash(made, "network").collect(), key=lambda r: r.piece)  # as long as the network
    if not found:
        return net
    return net.filled(np.concatenate([np.array(r.sums) for r in found]) / found[0].n)


def train(docs: DataFrame) -> Model:
    ship(docs.sparkSession)
    counts = stash(_word_counts(docs), "words")
    top = [(bytes(r.word), r.n) for r in _frequent(counts)]
    own = {w: i for i, (w, _) in enumerate(top[:OWN])}
    totals = _totals(counts, top)
    net, targets = fresh(totals), Targets(own)
    seen = net.filled(np.full(net.flat().size, 1e-4))
    x, y = windows([targets.ids(words(t)) for t in _start(docs)])
    rng = np.random.default_rng(11)
    for _ in range(PASSES):
        at = rng.permutation(len(y))
        train_on(net, seen, x[at], y[at])
    net = _refined(docs, own, net, seen)
    return Model(own, net, dict(top), totals, _others(counts, top))


def _others(counts: DataFrame, top: list[tuple[bytes, int]]) -> DataFrame:
    if len(top) < VOCABULARY:
        return counts.limit(0)
    last, least = top[-1]
    return counts.where((F.col("n") < least) | (F.col("n") == least) & (F.col("word") > F.lit(last)))


OTHERS = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))


class Counts:
    """Counts of frequent words."""

    def __init__(self, counts: dict[bytes, int]) -> None:
        self.words, self.n = pa.array(list(counts), pa.binary()), np.array([*counts.values(), -1], np.int64)

    def of(self, found: pa.Array) -> np.ndarray:
        """-1 for words that are not among them."""
        return self.n[_places(found, self.words)]


def _parts(texts: pa.Array, model: Model, targets: Targets, counts: Counts) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each text: its number of words, the sum of log-probabilities but for the counts of words that are not in
    model.counts, and these words with how often they occur."""
    sizes, found = parted(texts)
    found = found.dictionary_encode()
    distinct, at = found.dictionary, found.indices.to_numpy()
    k = targets.of(distinct)
    text = np.repeat(np.arange(len(texts)), sizes)
    totals = np.bincount(text, log_probabilities_along(model.network, laid(sizes, k[at])), len(texts)).astype(np.float64)
    rare = (k >= OWN)[at]
    pairs, n = np.unique(text[rare] * len(distinct) + at[rare], return_counts=True)
    text, at = np.divmod(pairs, max(len(distinct), 1))
    known, length = counts.of(distinct)[at], pc.binary_length(distinct).to_numpy()[at]
    cells = text * ENDINGS + k[at] - OWN
    held = np.bincount(cells, n, len(texts) * ENDINGS)
    groups = np.flatnonzero(held)
    totals -= np.bincount(groups // ENDINGS, held[groups] * np.log(model.totals[OWN + groups % ENDINGS] - held[groups] + 1), len(texts))
    elsewhere = np.where(known > n, np.log(np.maximum(known - n, 1)), SPELLED * length)
    here = known >= 0
    totals += np.bincount(text[here], (n * elsewhere)[here], len(texts))
    rest = pa.StructArray.from_arrays([distinct.take(pa.array(at[~here])), pa.array(n[~here], pa.int64())], fields=list(OTHERS.value_type))
    offsets = np.concatenate(([0], np.cumsum(np.bincount(text[~here], minlength=len(texts)))))
    return sizes, totals, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rest, type=OTHERS)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, log_likelihood, mean_log_likelihood, for documents that the model has counted.

    A word beyond the OWN most frequent ones has, within its group, its count in other texts out of the group's words in
    other texts and one; if no other text has it, that one's share, spelled in letters of equal chance (1/26 a byte).
    Null, empty and blank texts have no words: log_likelihood 0, means null. Repeated rows are texts of their own and score
    alike; rows without doc_id are scored as others; an empty table gives none. Columns beside doc_id and text are not read.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model._replace(others=None))  # bounded by VOCABULARY and TARGETS

    kind = _parse_datatype_string("doc_id long, n_words long, part double, others array<struct<word: binary, n: long>>")
    arrow = to_arrow_schema(kind)

    def run(batches):
        model = shared.value
        targets, counts = Targets(model.own), Counts(model.counts)
        for batch in batches:
            at = 0
            for texts in portions(batch.column(1)):
                sizes, totals, others = _parts(texts, model, targets, counts)
                ids = batch.column(0).slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(totals), others.cast(arrow.field(3).type)], schema=arrow)
                at += len(texts)

    parts = docs.select("doc_id", "text").mapInArrow(run, kind)
    parts = stash(parts.withColumn("row", F.monotonically_increasing_id()), "parts")
    # a word past the VOCABULARY most frequent ones has less than 1 / VOCABULARY of what was counted: no hot key
    found = parts.select("row", F.inline("others")).withColumnRenamed("n", "own").join(model.others.where("n > 1"), "word", "left")
    left = F.coalesce("n", F.lit(0)) - F.col("own")  # not above 0 for a word that occurs once, whether joined or not
    units = F.col("own") * F.round(F.when(left > 0, F.log(left)).otherwise(SPELLED * F.length("word")) * UNIT).cast("long")
    sums = found.select("row", units.alias("units")).groupBy("row").agg(F.sum("units").alias("units"))
    total = F.col("part") + F.coalesce("units", F.lit(0)) / UNIT
    scored = parts.drop("others").join(sums, "row", "left").withColumn("log_likelihood", total)
    return scored.select("doc_id", "n_words", "log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")).alias("mean_log_likelihood"))


def digest(docs: DataFrame) -> DataFrame:
    return score(docs, train(docs))
