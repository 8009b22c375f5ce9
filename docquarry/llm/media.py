"""Copies of images, also cropped, scaled, turned or toned, by local descriptors.

Each image is reduced step by step; on each level corners are found by the Harris measure. A corner gets
an orientation (towards the centre of brightness around it) and a descriptor of 128 binary tests, each of
two smoothed pixels at places turned by that orientation. Descriptors meet in Hamming tables: one under
each two of their six parts of ``PART`` bits, so that two within four bits surely meet, those within
``BITS`` mostly, and others hardly ever. Pairs that differ in at most ``BITS`` bits are matches, and an
image is a copy of another if enough matches agree on one similarity transform; not every corner has to
meet for that. Query images are also described on the levels in between, so that the scales of a copy and
its original are never far apart.

Images with the same bytes are one class, told by its digest: their descriptors are one row from before the
shuffle, links are between classes, and the ids come back by membership. Copies by the same bytes alone,
without corners (those too small for one), have 0 as ``n_matches`` and ``n_agreeing``.

The index rows that leave a task are those whose keys some query may have: a bitmap of the queries' keys,
``BITMAP`` bits whatever their number, is sent to the tasks. A full bitmap lets every row pass.

Images are binary PGM (P5, one byte a pixel). Defined cases: null, empty or unreadable images and such of
one tone match nothing; those without corners match only the same bytes; repeated rows each are images of their own
and are listed for each; images with a null id are not listed; very large images are described so many
corners at a time; an empty table gives no rows. Only the id and image columns are read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import checkpoint, small_batches

#: Radius of a patch, tests, scale from a level to the next; levels go on until one is smaller than a patch.
RADIUS, TESTS, STEP = 15, 128, 0.85
#: Bits of a part of a descriptor, and the two parts of each table.
PART, PARTS = 21, 6
TABLES = list(combinations(range(PARTS), 2))
#: Bits in which matching descriptors may differ.
BITS = 12
#: Bits of the map of the queries' keys, a power of two.
BITMAP = 1 << 26
#: Corners described at a time.
SLICE = 4096
#: Query images that meet the index together.
BLOCK = 256
#: Rows from which a task hands a batch on.
ROWS = 1 << 14
#: Matches that must agree on a transform, within so many pixels of the indexed image.
AGREE, TOLERANCE = 4, 5.0


def encode_pgm(pixels: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % pixels.shape[::-1] + pixels.astype(np.uint8).tobytes()


def decode_pgm(data: bytes | None) -> np.ndarray | None:
    head = re.match(rb"P5\s+(?:#[^\n]*\n)*(\d+)\s+(\d+)\s+(\d+)\s", data or b"")
    if not head:
        return None
    width, height, most = map(int, head.groups())
    if not 0 < most < 256 or not width * height or len(data) < head.end() + width * height:  # type: ignore[arg-type]
        return None
    return np.frombuffer(data, np.uint8, width * height, head.end()).reshape(height, width).astype(np.float32)  # type: ignore[arg-type]


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of 2 r + 1, with the border repeated."""
    p = np.pad(x, r + 1, mode="edge")[:-1, :-1].astype(np.float64)
    p[0], p[:, 0] = 0, 0
    s = p.cumsum(0).cumsum(1)
    k = 2 * r + 1
    return ((s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / k**2).astype(np.float32)


def scaled(x: np.ndarray, factor: float) -> np.ndarray:
    """Bilinear, after smoothing if it gets smaller."""
    if factor < 1:
        x = _box(x, 1)
    h, w = max(1, round(x.shape[0] * factor)), max(1, round(x.shape[1] * factor))
    ys, xs = (np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in ((h, x.shape[0]), (w, x.shape[1])))
    y0, x0 = ys.astype(int), xs.astype(int)
    y1, x1 = np.minimum(y0 + 1, x.shape[0] - 1), np.minimum(x0 + 1, x.shape[1] - 1)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None, :]
    return ((x[y0][:, x0] * (1 - fx) + x[y0][:, x1] * fx) * (1 - fy) + (x[y1][:, x0] * (1 - fx) + x[y1][:, x1] * fx) * fy).astype(np.float32)


@cache
def _pattern() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the tests (from a fixed seed), and the disc over which the orientation is taken."""
    rng = np.random.default_rng(7)
    places = rng.normal(0, RADIUS / 1.6, (2, TESTS, 2)).clip(-RADIUS * 0.7, RADIUS * 0.7)
    y, x = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
    inside = x * x + y * y <= RADIUS * RADIUS
    return places, y[inside], x[inside]


def _corners(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and strengths of the local maxima of the Harris measure, away from the border."""
    m = RADIUS + 1
    if min(x.shape) <= 2 * m:
        return (np.zeros(0, int),) * 2 + (np.zeros(0),)  # type: ignore[return-value]
    gy, gx = np.gradient(_box(x, 1))
    a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
    r = a * b - c * c - 0.05 * (a + b) ** 2
    best = r
    for axis in (0, 1):
        best = np.max([np.roll(best, i, axis) for i in range(-2, 3)], axis=0)
    inner = np.zeros(x.shape, bool)
    inner[m:-m, m:-m] = True
    ys, xs = np.nonzero((r == best) & (r > 1.0) & inner)
    return ys, xs, r[ys, xs]


def _tests(level: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angle and descriptor bytes of each corner of a level."""
    places, dy, dx = _pattern()
    smooth, angles, bits = _box(level, 2), [], []
    for i in range(0, len(ys), SLICE):
        y, x = ys[i : i + SLICE, None], xs[i : i + SLICE, None]
        disc = level[y + dy, x + dx]
        angle = np.arctan2((disc * dy).sum(1), (disc * dx).sum(1))
        cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
        at = []
        for p in places:
            px, py = p[:, 0] * cos - p[:, 1] * sin, p[:, 0] * sin + p[:, 1] * cos
            at.append(smooth[np.rint(y + py).astype(int), np.rint(x + px).astype(int)])
        angles.append(angle)
        bits.append(np.packbits(at[0] < at[1], axis=1))
    return np.concatenate(angles), np.concatenate(bits)


def describe(image: np.ndarray, fine: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """``x, y, scale, angle`` of each corner in pixels of the image, and its descriptor as two 64-bit halves.

    All corners count, so their number grows with the image. ``fine`` adds the levels halfway between.
    """
    found, bits = [], []
    for below, factor in [(image, 1.0)] + ([(scaled(image, STEP**0.5), STEP**0.5)] if fine else []):
        while min(below.shape) > 2 * (RADIUS + 1):
            level, here = below, factor
            below, factor = scaled(level, STEP), factor * STEP
            ys, xs, _ = _corners(level)
            if not len(ys):
                continue
            angle, code = _tests(level, ys, xs)
            bits.append(code)
            size_y, size_x = image.shape[0] / level.shape[0], image.shape[1] / level.shape[1]
            found.append(np.stack([(xs + 0.5) * size_x, (ys + 0.5) * size_y, np.full(len(xs), 1 / here), angle], axis=1))
    if not found:
        return np.zeros((0, 4)), np.zeros((0, 2), np.int64)
    return np.concatenate(found), np.concatenate(bits).view(">i8").astype(np.int64).reshape(-1, 2)


def table_keys(codes: np.ndarray) -> np.ndarray:
    """A row per descriptor: its key in each table, two parts and the number of the table."""
    halves, mask = codes.view(np.uint64), np.uint64((1 << PART) - 1)
    part = [halves[:, n // 3] >> np.uint64(PART * (n % 3)) & mask for n in range(PARTS)]
    return np.stack([np.uint64(k << 2 * PART) | part[i] << np.uint64(PART) | part[j] for k, (i, j) in enumerate(TABLES)], axis=1).view(np.int64)


def bitmap_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key in the map."""
    x = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return (x & np.uint64(BITMAP - 1)).view(np.int64), (x >> np.uint64(64 - BITMAP.bit_length() + 1)).view(np.int64)


def _packed(places: np.ndarray) -> np.ndarray:
    """x and y in eighths of a pixel (20 bits each), half level (6) and angle (12) in one number, which tells a corner of an image."""
    x, y = (np.rint(places[:, k] * 8).astype(np.int64) & 0xFFFFF for k in (0, 1))
    level = np.rint(2 * np.log(places[:, 2]) / np.log(1 / STEP)).astype(np.int64) & 0x3F
    angle = np.rint(places[:, 3] * (4096 / (2 * np.pi))).astype(np.int64) & 0xFFF
    return x << 38 | y << 18 | level << 12 | angle


def _placed(places: list[int]) -> np.ndarray:
    """Rows ``x, y, scale, angle``."""
    n = np.array(places, np.int64)
    return np.column_stack([(n >> 38 & 0xFFFFF) / 8, (n >> 18 & 0xFFFFF) / 8, STEP ** -((n >> 12 & 0x3F) / 2), (n & 0xFFF) * (2 * np.pi / 4096)])


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:16]


def _readable(data: bytes | None) -> np.ndarray | None:
    pixels = decode_pgm(data)
    return None if pixels is None or pixels.min() == pixels.max() else pixels


def descriptors(images: DataFrame, *, image_col: str = "image", fine: bool = False, asked=None) -> DataFrame:
    """A row for each corner of a readable image and each table: ``digest, place, hi, lo, key``.

    ``asked``: a broadcast bitmap; rows whose key is not in it are left out.
    """
    rows = small_batches(images).select(F.col(image_col).cast("binary").alias("image"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None if asked is None else np.frombuffer(asked.value, np.uint8)
        ready: list[pa.RecordBatch] = []

        def together() -> pa.RecordBatch:
            table = pa.Table.from_batches(ready).combine_chunks()
            ready.clear()
            return table.to_batches()[0]

        for batch in batches:
            # Of the same bytes in a batch one is described.
            for data in dict.fromkeys(batch.column("image").to_pylist()):
                pixels = _readable(data)
                if pixels is None:
                    continue
                corners, codes = describe(pixels, fine)
                keys = table_keys(codes)
                use = np.ones(keys.shape, bool)
                if held is not None:
                    for at in bitmap_places(keys):
                        use &= (held[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                of, table = np.nonzero(use)
                if not len(of):
                    continue
                columns = [pa.array([_digest(data)] * len(of), pa.binary()), *(pa.array(x) for x in (_packed(corners)[of], codes[of, 0], codes[of, 1], keys[of, table]))]
                ready.append(pa.RecordBatch.from_arrays(columns, ["digest", "place", "hi", "lo", "key"]))
                if sum(x.num_rows for x in ready) >= ROWS:
                    yield together()
        if ready:
            yield together()

    return rows.mapInArrow(run, "digest binary, place bigint, hi bigint, lo bigint, key bigint").distinct()


def _bitmap(keys: DataFrame) -> bytes:
    """The map of the keys; what reaches the driver is ``BITMAP`` bits at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(bitmap_places(batch.column("key").to_numpy())))], ["at"])

    blocks = keys.select("key").mapInArrow(run, "at bigint").groupBy(F.expr("at div 32768").alias("block")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits"))
    out = bytearray(BITMAP // 8)
    for block, bits in blocks.toLocalIterator():
        out[block * 4096 : (block + 1) * 4096] = bits
    return bytes(out)


def agreeing(q: np.ndarray, p: np.ndarray, tolerance: float = TOLERANCE) -> int:
    """Most matches (rows ``x, y, scale, angle``) that one match's transform from q to p explains; a corner counts once."""
    size, turn = p[:, 2] / q[:, 2], p[:, 3] - q[:, 3]
    cos, sin = size * np.cos(turn), size * np.sin(turn)
    best = 0
    for k in range(len(q)):
        dx, dy = q[:, 0] - q[k, 0], q[:, 1] - q[k, 1]
        off = np.hypot(p[k, 0] + cos[k] * dx - sin[k] * dy - p[:, 0], p[k, 1] + sin[k] * dx + cos[k] * dy - p[:, 1])
        inside = off <= tolerance
        # No more corners than matches: most need no further look.
        if inside.sum() <= best:
            continue
        best = max(best, min(len(np.unique(q[inside, :2].round(1), axis=0)), len(np.unique(p[inside, :2].round(1), axis=0))))
    return best


def members(images: DataFrame, *, id_col: str = "image_id", image_col: str = "image") -> DataFrame:
    """``id, digest`` of each image; the digest is null if the image can't be read or has one tone."""
    rows = small_batches(images).select(F.col(id_col).alias("id"), F.col(image_col).cast("binary").alias("image")).where("id IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [None if _readable(data) is None else _digest(data) for data in batch.column("image").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(digests, pa.binary())], ["id", "digest"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, digest binary")


def links(images: DataFrame, wanted: DataFrame, *, image_col: str = "image", bits: int = BITS, agree: int = AGREE) -> DataFrame:
    """``q_digest, digest, n_matches, n_agreeing`` of each two classes, one of query images (``wanted``), that are copies with corners."""
    asked = checkpoint(descriptors(wanted, image_col=image_col, fine=True).toDF("q_digest", "q_place", "q_hi", "q_lo", "q_key"))
    sent = images.sparkSession.sparkContext.broadcast(_bitmap(asked.select(F.col("q_key").alias("key"))))
    index = descriptors(images, image_col=image_col, asked=sent)
    part = lambda n, hi, lo: F.shiftrightunsigned(lo if n // 3 else hi, PART * (n % 3)).bitwiseAND((1 << PART) - 1)
    first = [next((k for k, (i, j) in enumerate(TABLES) if m >> i & 1 and m >> j & 1), -1) for m in range(1 << PARTS)]

    def matching(q: Column) -> Column:
        apart = F.bit_count(F.col("hi").bitwiseXOR(q["q_hi"])) + F.bit_count(F.col("lo").bitwiseXOR(q["q_lo"]))
        # Two descriptors may meet in several tables; they are a match in that of the first two parts that agree.
        same = sum((F.when(part(n, F.col("hi"), F.col("lo")) == part(n, q["q_hi"], q["q_lo"]), 1 << n).otherwise(0) for n in range(PARTS)), F.lit(0))
        return (apart <= bits) & (F.element_at(F.lit(first), same + 1) == F.shiftrightunsigned("key", 2 * PART))

    # The corners of query images under a key meet the index as one row, so many blocks of images give so many rows at most.
    blocks = max(1, -(-asked.select("q_digest").distinct().count() // BLOCK))
    block = F.pmod(F.xxhash64("q_digest"), F.lit(blocks)).alias("block")
    held = asked.groupBy(block, "q_key").agg(F.collect_list(F.struct("q_hi", "q_lo", "q_digest", "q_place")).alias("corners"))
    met = index.join(held, (F.col("key") == F.col("q_key")) & F.exists("corners", matching))
    met = met.select("block", "digest", "place", F.transform(F.filter("corners", matching), lambda q: F.struct(q["q_digest"], q["q_place"])).alias("holders"))
    # Bounded by the corners of an image and of a block; each corner of the image that a copy needs is a row.
    pairs = met.groupBy("block", "digest").agg(F.collect_list(F.struct("place", "holders")).alias("met")).where(F.size("met") >= agree).select("digest", "met")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[bytes, bytes, int, int]] = []
            for digest, rows in zip(batch.column("digest").to_pylist(), batch.column("met"), strict=True):
                of: dict[bytes, set[tuple[int, int]]] = {}
                for x in rows.as_py():
                    for q in x["holders"]:
                        of.setdefault(q["q_digest"], set()).add((q["q_place"], x["place"]))
                for q_digest, matches in of.items():
                    if len(matches) >= agree:
                        mine, its = zip(*sorted(matches), strict=True)
                        n = agreeing(_placed(list(mine)), _placed(list(its)))
                        if n >= agree:
                            out.append((q_digest, digest, len(matches), n))
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64())
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["q_digest", "digest", "n_matches", "n_agreeing"])

    return pairs.mapInArrow(run, "q_digest binary, digest binary, n_matches bigint, n_agreeing bigint")


def _all_links(images: DataFrame, wanted: DataFrame, image_col: str, bits: int, agree: int, classes: DataFrame, asked: DataFrame) -> DataFrame:
    """``links`` and those between the same bytes."""
    alike = asked.select("digest").distinct().join(classes.select("digest"), "digest").select(F.col("digest").alias("q_digest"), "digest", F.expr("0L AS n_matches"), F.expr("0L AS n_agreeing"))
    found = links(images, wanted, image_col=image_col, bits=bits, agree=agree).unionByName(alike)
    return found.groupBy("q_digest", "digest").agg(F.max("n_matches").alias("n_matches"), F.max("n_agreeing").alias("n_agreeing"))


def find_copies(images: DataFrame, wanted: DataFrame, *, id_col: str = "image_id", image_col: str = "image", bits: int = BITS, agree: int = AGREE) -> DataFrame:
    """``query_id, id, n_matches, n_agreeing`` of each image that a query image (``wanted``, same columns) is a copy of."""
    own, asked = (members(x, id_col=id_col, image_col=image_col).where("digest IS NOT NULL") for x in (images, wanted))
    found = _all_links(images, wanted, image_col, bits, agree, own.select("digest").distinct(), asked)
    listed = asked.withColumnsRenamed({"id": "query_id", "digest": "q_digest"})
    return found.join(own, "digest").join(listed, "q_digest").select("query_id", "id", "n_matches", "n_agreeing").distinct()


def count_copies(images: DataFrame, wanted: DataFrame, *, id_col: str = "image_id", image_col: str = "image", bits: int = BITS, agree: int = AGREE) -> DataFrame:
    """A row per query image: ``query_id``, ``copy_of`` (the least id of its copies, null without), ``n_copies`` (rows), ``n_classes``
    (of different bytes) and ``n_agreeing`` (the most). Classes are counted, never expanded."""
    asked = checkpoint(members(wanted, id_col=id_col, image_col=image_col))
    own = members(images, id_col=id_col, image_col=image_col).where("digest IS NOT NULL")
    classes = checkpoint(own.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    found = _all_links(images, wanted, image_col, bits, agree, classes, asked.where("digest IS NOT NULL"))
    counted = found.join(classes, "digest").groupBy("q_digest").agg(F.min("least").alias("copy_of"), F.sum("n").alias("n_copies"), F.count("*").alias("n_classes"), F.max("n_agreeing").alias("n_agreeing"))
    n = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return asked.join(counted, F.col("digest") == F.col("q_digest"), "left").select(F.col("id").alias("query_id"), "copy_of", n("n_copies"), n("n_classes"), n("n_agreeing"))


#: Side of a drawn vector, and the wave lengths that it is drawn with.
SIDE, WAVES = 96, (8.0, 40.0)


@cache
def _waves(n: int) -> np.ndarray:
    rng = np.random.default_rng(11)
    length, angle, phase = rng.uniform(*WAVES, n), rng.uniform(0, np.pi, n), rng.uniform(0, 2 * np.pi, n)
    y, x = np.mgrid[:SIDE, :SIDE]
    across = np.cos(angle)[:, None, None] * x + np.sin(angle)[:, None, None] * y
    return np.cos(2 * np.pi * across / length[:, None, None] + phase[:, None, None]).reshape(n, -1).astype(np.float32)


def picture(vector: list[float]) -> np.ndarray:
    """A vector drawn as a sum of waves, one for each of its numbers: close vectors give alike pictures."""
    v = np.array(vector, np.float32)
    z = v @ _waves(len(v))
    return np.clip(128 + 50 * (z - z.mean()) / (z.std() or 1), 0, 255).reshape(SIDE, SIDE).astype(np.uint8)


def edited(pixels: np.ndarray, kind: int, seed: int) -> np.ndarray:
    """A copy: cropped, turned by a right angle, toned with noise, or made smaller."""
    rng = np.random.default_rng(seed)
    h, w = pixels.shape
    if kind == 0:
        y, x = rng.integers(0, h // 4 + 1), rng.integers(0, w // 4 + 1)
        return pixels[y : y + 3 * h // 4, x : x + 3 * w // 4]
    if kind == 1:
        return np.rot90(pixels).copy()
    if kind == 2:
        return np.clip(pixels * 0.8 + 20 + rng.normal(0, 3, pixels.shape), 0, 255).astype(np.uint8)
    return scaled(pixels.astype(np.float32), 0.8).astype(np.uint8)


def drawn(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", edit: bool = False) -> DataFrame:
    """``id`` and ``image`` of each vector; with ``edit`` an edited copy, the edit chosen by the id or, if that is no integer, its checksum."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some, images = batch.slice(start, 256), []
                for n, v in zip(some.column("id").to_pylist(), some.column("vector").to_pylist(), strict=True):
                    pixels = None if n is None or not v or None in v else picture(v)
                    if pixels is not None and edit:
                        seed = n if isinstance(n, int) else zlib.crc32(str(n).encode())
                        pixels = edited(pixels, seed // 100 % 4, abs(seed))
                    images.append(None if pixels is None else encode_pgm(pixels))
                yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(images, pa.binary())], [id_col, "image"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, image binary")
