"""Hashed text vectors and vector arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia import params as P
from evidentia.functions.text import cleaned_words
from evidentia.functions.words import parts, spans, string_bytes

#: Words and rows that a task embeds at a time.
PART_WORDS, PART_ROWS = 1 << 17, 1024


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bit, over the characters of an ASCII string."""
    codes = F.transform(F.split(text, ""), lambda ch: F.ascii(ch).cast("long"))
    return F.aggregate(
        codes,
        F.lit(P.FNV_OFFSET).cast("long"),
        lambda h, c: (h.bitwiseXOR(c) * F.lit(P.FNV_PRIME).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")),
    )


def grams(text: Column) -> Column:
    """Words longer than one character, and pairs of neighbours joined by ``_``."""
    words = F.filter(cleaned_words(text), lambda w: F.length(w) > 1)
    pairs = F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.concat(a, F.lit("_"), b))
    return F.concat(words, F.filter(pairs, lambda p: p.isNotNull()))


def gram_buckets(text: Column, dim: int = P.HASH_DIM) -> Column:
    return F.transform(grams(text), lambda g: (fnv1a(g) % dim).cast("int"))


def _fnv_steps(state, starts, sizes, data):
    """Continue FNV-1a over byte spans, all spans of a batch one byte at a time."""
    import numpy as np

    longest = int(sizes.max()) if len(sizes) else 0
    # Short keys are sorted by digits, in linear time.
    order = np.argsort((longest - sizes).astype(np.uint16) if longest < 1 << 16 else -sizes, kind="stable")
    state, starts, sizes = state[order], starts[order], sizes[order]
    prime, falling = np.uint32(P.FNV_PRIME), -sizes
    for i in range(longest):
        live = np.searchsorted(falling, -i, side="left")
        state[:live] = (state[:live] ^ data[starts[:live] + i]) * prime
    out = np.empty_like(state)
    out[order] = state
    return out


def _embedded(data, starts, sizes, owner, n, dim):
    """Unit vectors of ``n`` rows from the spans of their words.

    The hash of a pair continues from the hash of its first word, so no pair is ever built as text.
    """
    import numpy as np

    single = _fnv_steps(np.full(len(starts), P.FNV_OFFSET, np.uint32), starts, sizes, data)
    joined = (single[:-1] ^ np.uint32(ord("_"))) * np.uint32(P.FNV_PRIME)
    inside = owner[1:] == owner[:-1]
    pairs = _fnv_steps(joined[inside], starts[1:][inside], sizes[1:][inside], data)
    cells = np.concatenate([owner * dim + single % dim, owner[1:][inside] * dim + pairs % dim])
    counts = np.bincount(cells, minlength=n * dim)
    # Counts are small, so their logarithms are looked up.
    weights = np.r_[0.0, 1.0 + np.log(np.arange(1.0, counts.max(initial=0) + 1))]
    out = weights[counts].reshape(n, dim)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    out /= np.where(norm == 0, 1.0, norm)
    return out


def _vector_array(out, dim):
    import numpy as np
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dim), pa.int32()), pa.array(out.ravel()))


def word_vector(dim: int = P.HASH_DIM):
    """Arrow-batched helper: word lists to unit vectors of ``1 + ln(count)`` over hashed words and pairs."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def dense(words):
        import numpy as np

        out = np.zeros((len(words), dim))
        # Rows in parts of a bounded number of words; a longer text is a part by itself.
        for low, high in parts(np.asarray(words.offsets), PART_WORDS, PART_ROWS):
            rows = words.slice(low, high - low)
            flat = rows.flatten()
            data, edges = string_bytes(flat)
            bounds = np.asarray(rows.offsets)
            owner = np.repeat(np.arange(high - low), np.diff(bounds))
            out[low:high] = _embedded(data, edges[:-1], np.diff(edges), owner, high - low, dim)
        return _vector_array(out, dim)

    return dense


def text_vector(dim: int = P.HASH_DIM, single: bool = False):
    """Arrow-batched helper: lower-cased texts to the vectors of their words of two characters or more, rounded to floats if ``single``."""

    @F.arrow_udf(T.ArrayType(T.FloatType() if single else T.DoubleType()))
    def dense(texts):
        import numpy as np

        out = np.zeros((len(texts), dim), np.float32 if single else np.float64)
        for low, high, data, starts, sizes, owner in spans(texts):
            long = sizes > 1
            out[low:high] = _embedded(data, starts[long], sizes[long], owner[long], high - low, dim)
        return _vector_array(out, dim)

    return dense


def _runs(starts, sizes):
    """The places ``starts[0], starts[0] + 1, ...`` of runs of the given sizes, one run after the other."""
    import numpy as np

    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _bit_places(sizes):
    """Words of 32 bits that the bits of each vector take, and where each number's bit lies among those of all (NULL: one after the other)."""
    import numpy as np

    room = (sizes + 31) // 32
    return room, _runs(32 * (np.cumsum(room) - room), sizes) if (sizes % 32).any() else None


def pack_floats():
    """Arrow-batched helper: vectors to words of four bytes, low byte first: the length, a bit per number that tells whether it is
    stored, then the floats stored. Only zeros are left out; a missing number becomes zero, as in ``dot``."""

    @F.arrow_udf(T.BinaryType())
    def pack(vectors):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        flat = pc.fill_null(vectors.flatten().cast(pa.float32()), 0).to_numpy(zero_copy_only=False).astype("<f4").view("<u4")
        there = vectors.is_valid().to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        # Zero by its bits, so that a negative zero stays one.
        kept = flat != 0
        counts = np.diff(np.r_[0, np.cumsum(kept)][np.r_[0, np.cumsum(sizes)]])
        room, places = _bit_places(sizes)
        bits = kept
        if places is not None:
            bits = np.zeros(32 * room.sum(), bool)
            bits[places] = kept
        edges = np.r_[0, np.cumsum(np.where(there, 1 + room + counts, 0))]
        at, out = edges[:-1], np.zeros(edges[-1], "<u4")
        out[at[there]] = sizes[there]
        out[_runs(at + 1, room)] = np.packbits(bits).view("<u4")
        out[_runs(at + 1 + room, counts)] = flat[kept]
        rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(vectors), [None, pa.py_buffer(4 * edges), pa.py_buffer(out)])
        return pc.if_else(vectors.is_valid(), rows, pa.scalar(None, pa.large_binary())).cast(pa.binary())

    return pack


def unpack_floats():
    """Arrow-batched helper: the vectors that ``pack_floats`` made bytes of."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def unpack(packed):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        words = np.frombuffer(b"".join(b for b in packed.to_pylist() if b), "<u4")
        there = packed.is_valid().to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.fill_null(pc.binary_length(packed), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 4)
        at, sizes = np.r_[0, ends[:-1]][:len(ends)], np.zeros(len(packed), np.int64)
        sizes[there] = words[at[there]]
        room, places = _bit_places(sizes)
        kept = np.unpackbits(words[_runs(at + 1, room)].view(np.uint8)).astype(bool)
        kept = kept if places is None else kept[places]
        first = np.where(there, at + 1 + room, ends)
        flat = np.zeros(len(kept), "<u4")
        flat[kept] = words[_runs(first, ends - first)]
        edges = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
        return pa.ListArray.from_arrays(edges, pa.array(flat.view("<f4"), pa.float32()), mask=packed.is_null())

    return unpack


def hashed_vector(text: Column, dim: int = P.HASH_DIM, single: bool = False) -> Column:
    return text_vector(dim, single)(F.lower(text))


def dot(a: Column, b: Column) -> Column:
    """Dot product over the shorter length: the cosine of unit vectors."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + F.coalesce(p, F.lit(0.0)))


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, F.lit(1.0)).otherwise(norm))
