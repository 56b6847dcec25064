"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and decoding.

A lattice has a state after every character and an edge for every piece of the model that spells the
characters between two states.  A piece's weight is ``alpha`` times its Zipf log-probability by the
model's own rank.  The forward pass gives every state the log-sum of all paths to it; the backward
pass starts at the end and draws each last piece with its exact posterior.  The uniform number for a
draw is a hash of (seed, row key, position in the text): the same row gives the same pieces in any
partitioning, batch size or retry, and another seed gives another segmentation.

Between two characters that no piece holds side by side every path has a state, so the lattice of a text falls
apart there into independent units.  Equal units of a batch share one lattice; every occurrence draws its own path.  Texts are processed whole, in slices of rows of at most
``SLICE_CHARS`` bytes (a longer text is a slice of its own).

Lossless: a space is the piece symbol U+2581, a character without a piece (U+2581 itself included) is
its UTF-8 bytes as byte pieces, one space goes before the text and is taken off again.  Control pieces are
never produced: their strings in a text are ordinary text.

Defined cases: null gives null pieces and decodes to null; an empty text gives no pieces; equal rows give
equal pieces; a null key is drawn as the key ''.  Columns beside the text pass through unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALPHA = 0.5
SEED = 42
SLICE_CHARS = 1 << 18
ZIPF_SHIFT = 2.7


HASH_BITS = 19
HASH_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: characters below this have their own place in the table of neighbours; all others share the last
NEAR = 1024


def _slot(key: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((key.astype(np.uint64) * HASH_FACTOR) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


@dataclass
class Pieces:
    """The model as arrays: a trie over the pieces (transitions in an open hash table), their weights, the
    bytes that each decodes to, and which characters stand side by side in some piece."""
    key: np.ndarray         # by slot: node << 21 | character, or -1
    child: np.ndarray       # by slot
    piece: np.ndarray       # by node: its piece or -1
    logp: np.ndarray        # by piece
    byte_id: np.ndarray     # by byte value
    spelled: list[bytes]    # by piece
    depth: int
    joined: np.ndarray      # [a, b]: may b follow a inside a piece

    @classmethod
    def load(cls, model_path: str) -> Pieces:
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.get_piece_size()
        trie, ends, spelled = {}, {}, []
        byte_id, rank = np.zeros(256, np.int32), np.full(n, float(n))
        joined = np.zeros((NEAR, NEAR), bool)
        depth = 1
        for i in range(n):
            text = model.id_to_piece(i).replace("▁", " ")
            if model.is_byte(i):
                value = int(text[3:5], 16)
                byte_id[value] = i
                spelled.append(bytes([value]))
                continue
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                spelled.append(b"")
                continue
            spelled.append(text.encode())
            rank[i] = -model.get_score(i)
            depth = max(depth, len(text))
            node = 0
            for c in text:
                node = trie.setdefault((node, ord(c)), len(trie) + 1)
            ends[node] = i
            near = [min(ord(c), NEAR - 1) for c in text]
            joined[near[:-1], near[1:]] = True
        piece = np.full(len(trie) + 1, -1, np.int32)
        piece[list(ends)] = list(ends.values())
        logp = -np.log(rank + ZIPF_SHIFT)
        logp -= np.log(np.exp(logp).sum())
        key, child = np.full(1 << HASH_BITS, -1, np.int64), np.zeros(1 << HASH_BITS, np.int64)
        for (node, c), to in trie.items():
            at = int(_slot(np.array([node << 21 | c]))[0])
            while key[at] >= 0:
                at = (at + 1) % len(key)
            key[at], child[at] = node << 21 | c, to
        return cls(key, child, piece, logp, byte_id, spelled, depth, joined)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The nodes after one more character, -1 where no piece goes on so."""
        want = node << 21 | code
        at = _slot(want)
        held = self.key[at]
        out = np.where(held == want, self.child[at], -1)
        open_ = np.flatnonzero((held != want) & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.key)
            held = self.key[at[open_]]
            hit = held == want[open_]
            out[open_[hit]] = self.child[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out

    def cuts(self, text: str) -> list[int]:
        """Where the lattice of a text falls apart: between neighbours that no piece holds side by side."""
        near = np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), NEAR - 1)
        return [0, *(np.flatnonzero(~self.joined[near[:-1], near[1:]]) + 1).tolist(), len(text)]


def _lattice(p: Pieces, units: list[str], alpha: float):
    """The lattices of different units.  A state is one character of one unit; states lie by position in the
    unit, longest units first, so one position of all units is one run.  Gives the first state of each
    position, the place of each unit in a run, and per (length - 1, state) the piece of that length ending
    there and the cumulative posterior of the lengths."""
    lens = np.fromiter(map(len, units), np.int64, len(units))
    place = np.empty(len(units), np.int64)
    by_length = np.argsort(-lens, kind="stable")
    place[by_length] = np.arange(len(units))
    # units at least so long: the size of each run
    runs = len(units) - np.searchsorted(lens[by_length[::-1]], np.arange(lens.max()), side="right")
    offset = np.cumsum(runs) - runs
    code = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
    total = len(code)
    unit_of = np.repeat(np.arange(len(units)), lens)
    pos = np.arange(total) - np.repeat(np.cumsum(lens) - lens, lens)
    state = offset[pos] + place[unit_of]
    left = lens[unit_of] - pos                              # characters from here to the end of the unit
    weight_of = np.exp(alpha * p.logp).astype(np.float32)
    ending, weight = [], []
    at, node = np.arange(total), np.zeros(total, np.int64)
    for length in range(1, p.depth + 1):
        if length > 1:
            fits = np.flatnonzero(left[at] >= length)
            at, node = at[fits], node[fits]
        node = p.step(node, code[at + length - 1])
        found = np.flatnonzero(node >= 0)
        at, node = at[found], node[found]
        if not len(at) and length > 1:
            break
        ids = p.piece[node]
        whole = np.flatnonzero(ids >= 0)
        ids, to = ids[whole], state[at[whole] + length - 1]
        e, w = np.full(total, -1, np.int32), np.zeros(total, np.float32)
        e[to], w[to] = ids, weight_of[ids]
        if length == 1:      # a character without a piece of its own: its bytes, written as -2 - character
            alone = np.flatnonzero(e[state] < 0)
            n_bytes = 1 + (code[alone] >= 0x80) + (code[alone] >= 0x800) + (code[alone] >= 0x10000)
            e[state[alone]] = -2 - code[alone]
            w[state[alone]] = weight_of.min() ** n_bytes
        ending.append(e)
        weight.append(w)
    # forward filtering, one position of all units at a time.  behind[k]: the total weight of the paths to the
    # state k + 1 characters back, as a multiple of the newest, so it neither overflows nor vanishes
    depth = len(ending)
    share = np.ones((depth, total), np.float32)
    behind = [np.ones(len(units))]
    for i, (s, n) in enumerate(zip(offset.tolist(), runs.tolist())):
        sums = []
        for k in range(min(i + 1, depth)):
            here = behind[k][:n] * weight[k][s:s + n]
            sums.append(here if not k else sums[-1] + here)
        inverse = 1 / sums[-1]
        for k in range(len(sums) - 1):
            share[k, s:s + n] = sums[k] * inverse
        behind = [np.ones(n), *(x[:n] * inverse for x in behind[:depth - 1])]
    return offset, place, lens, ending, share


def _uniform(key: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Splitmix64 of key + pos steps, as float32 in [0, 1)."""
    with np.errstate(over="ignore"):
        z = key + (pos.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(40)).astype(np.float32) * np.float32(2.0 ** -24)


def sample(p: Pieces, texts: list[str], keys: np.ndarray, alpha: float):
    """(pieces of all texts in a row, number of pieces per text); ``keys`` holds a 64-bit key per text."""
    number: dict[str, int] = {}
    units, per_text = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            t = " " + t
            at = p.cuts(t)
            per_text[i] = len(at) - 1
            units += [number.setdefault(t[a:b], len(number)) for a, b in zip(at, at[1:])]
    if not units:
        return np.empty(0, np.int32), per_text
    unit = np.array(units, np.int64)
    del units
    offset, place, lens, ending, share = _lattice(p, list(number), alpha)
    text_no = np.repeat(np.arange(len(texts)), per_text)
    size = lens[unit]
    chars = np.cumsum(size)
    base = np.zeros(len(texts), np.int64)
    some = per_text > 0
    firsts = (np.cumsum(per_text) - per_text)[some]
    base[some] = chars[firsts] - size[firsts]
    before = chars - base[text_no] - size                 # characters of the text before the occurrence
    live = np.arange(len(unit))
    left, row, key = size, place[unit], keys[text_no]
    steps = np.zeros(len(unit), np.int64)
    drawn = []
    while len(live):
        state = offset[left - 1] + row
        u = _uniform(key, before + left)
        back, ids = np.zeros(len(live), np.int64), ending[0][state]
        more = np.flatnonzero(share[0][state] <= u)
        for k in range(1, len(ending)):
            if not len(more):
                break
            at = state[more]
            back[more], ids[more] = k, ending[k][at]
            more = more[share[k][at] <= u[more]]
        drawn.append((live, ids))
        steps[live] += 1
        left = left - back - 1
        going = np.flatnonzero(left)
        live, left, row, key, before = (x[going] for x in (live, left, row, key, before))
    last = np.cumsum(steps) - 1
    out = np.empty(int(last[-1]) + 1, np.int32)
    for k, (occ, ids) in enumerate(drawn):
        out[last[occ] - k] = ids
    counts = np.bincount(text_no, steps, len(texts)).astype(np.int64)
    spelled = np.flatnonzero(out < 0)
    if len(spelled):
        code = -2 - out[spelled]
        times = np.ones(len(out), np.int64)
        times[spelled] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        owner = np.repeat(np.arange(len(texts)), counts)
        counts = np.bincount(owner, times, len(texts)).astype(np.int64)
        begin = (np.cumsum(times) - times)[spelled]
        out = np.repeat(out, times)
        for c in np.unique(code):
            own = begin[code == c]
            for j, byte in enumerate(chr(c).encode()):
                out[own + j] = p.byte_id[byte]
    return out, counts


def _slices(lengths: list[int], most: int):
    a = held = 0
    for i, n in enumerate(lengths):
        if i > a and held + n > most:
            yield a, i
            a, held = i, 0
        held += n
    if a < len(lengths):
        yield a, len(lengths)


def encode(df: DataFrame, model_path: str, key_col: str = "doc_id", text_col: str = "text", out_col: str = "pieces",
           alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """``df`` with the sampled pieces of ``text_col`` as array<int> ``out_col`` (replaced if there)."""
    shared = df.sparkSession.sparkContext.broadcast(Pieces.load(model_path))     # bounded by the model file
    rest = df.drop(out_col)
    names = rest.columns
    work = rest.toDF(*[f"c{i}" for i in range(len(names))])
    k, t, n = names.index(key_col), names.index(text_col), len(names)
    work = work.withColumn("key", F.coalesce(F.col(f"c{k}").cast("string"), F.lit("")))
    if not isinstance(work.schema[t].dataType, T.StringType):       # a string goes to Python once, as it is
        work, t = work.withColumn("text", F.col(f"c{t}").cast("string")), n + 1

    def run(batches):
        p = shared.value
        for b in batches:
            lengths = pc.fill_null(pc.binary_length(b.column(t)), 0).to_pylist()
            for i, j in _slices(lengths, SLICE_CHARS):
                part = b.slice(i, j - i)
                text = part.column(t)
                keys = np.array([xxhash.xxh64_intdigest(x, seed) for x in part.column(n).to_pylist()], np.uint64)
                ids, counts = sample(p, [x or "" for x in text.to_pylist()], keys, alpha)
                at = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                pieces = pa.ListArray.from_arrays(pa.array(at), pa.array(ids), mask=text.is_null())
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pieces], names=[*part.schema.names[:n], "pieces"])

    schema = T.StructType([*work.schema.fields[:n], T.StructField("pieces", T.ArrayType(T.IntegerType()))])
    return work.mapInArrow(run, schema).toDF(*names, out_col)


def _decoded(ids: np.ndarray, at: np.ndarray, first: np.ndarray, size: np.ndarray, data: np.ndarray):
    """(byte offsets of the texts, their bytes) for runs ``at`` of pieces whose bytes are data[first:first + size];
    the space before each text is left out."""
    n, begin = size[ids], first[ids]
    heads = at[:-1][at[1:] > at[:-1]]
    lead = heads[n[heads] > 0]
    n[lead] -= 1
    begin[lead] += 1
    ends = np.concatenate(([0], np.cumsum(n)))
    out = data[np.repeat(begin - ends[:-1], n) + np.arange(ends[-1])]
    return ends[at], out


def decode(df: DataFrame, model_path: str, pieces_col: str = "pieces", out_col: str = "decoded") -> DataFrame:
    """``df`` with the text of ``pieces_col`` as string ``out_col`` (replaced if there).  Pieces that are no
    valid UTF-8 together give replacement characters."""
    shared = df.sparkSession.sparkContext.broadcast(Pieces.load(model_path).spelled)
    rest = df.drop(out_col)
    names = rest.columns
    work = rest.toDF(*[f"c{i}" for i in range(len(names))])
    pos = names.index(pieces_col)

    def run(batches):
        size = np.array([len(x) for x in shared.value], np.int64)
        first, data = np.cumsum(size) - size, np.frombuffer(b"".join(shared.value), np.uint8)
        for b in batches:
            for i, j in _slices(pc.fill_null(pc.list_value_length(b.column(pos)), 0).to_pylist(), SLICE_CHARS // 2):
                part = b.slice(i, j - i)
                lists = part.column(pos)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                at, raw = _decoded(ids, np.concatenate(([0], np.cumsum(counts))), first, size, data)
                valid = pa.array(~np.asarray(lists.is_null()))
                text = pa.StringArray.from_buffers(len(lists), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw))
                try:
                    text.validate(full=True)
                except pa.ArrowInvalid:
                    text = pa.array([raw[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(at, at[1:])], pa.string())
                text = pc.if_else(valid, text, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, text], names=[*part.schema.names, "out"])

    schema = T.StructType([*work.schema.fields, T.StructField("out", T.StringType())])
    return work.mapInArrow(run, schema).toDF(*names, out_col)
