import numpy as np
import pytest

from docquarry.llm import media


def pictures(n, seed=0):
    rng = np.random.default_rng(seed)
    return [media.picture(rng.normal(0, 0.125, 64).tolist()) for _ in range(n)]


def test_pgm():
    p = pictures(1)[0]
    assert (media.decode_pgm(media.encode_pgm(p)) == p).all()
    assert media.decode_pgm(b"P5 # note\n".replace(b" # note", b"") + b"2 1\n255\nab").tolist() == [[97, 98]]
    for bad in (None, b"", b"P6\n1 1\n255\nabc", b"P5\n9 9\n255\nshort", b"P5\n0 0\n255\n", b"P5\n1 1\n65535\nab"):
        assert media.decode_pgm(bad) is None


def test_descriptors_turn_with_the_image():
    p = pictures(1)[0].astype(np.float32)
    a, b = media.describe(p), media.describe(np.rot90(p).copy())
    near = np.bitwise_count((a[1][:, None, :] ^ b[1][None, :, :]).view(np.uint64)).sum(2).min(1)
    assert np.median(near) <= 4


def frame(spark, images):
    return spark.createDataFrame([(i, None if p is None else bytearray(p)) for i, p in images], "image_id bigint, image binary")


@pytest.mark.parametrize("kind", range(4))
def test_edited_copies_are_found(spark, kind):
    originals = pictures(24)
    index = frame(spark, [(i, media.encode_pgm(p)) for i, p in enumerate(originals)])
    wanted = frame(spark, [(i, media.encode_pgm(media.edited(p, kind, i))) for i, p in enumerate(originals[:20])])
    got = {(r["query_id"], r["id"]) for r in media.find_copies(index, wanted).collect()}
    assert len({q for q, i in got if q == i}) >= 18 and not [x for x in got if x[0] != x[1]]


def test_table_search_against_brute_force(spark):
    """Of all matches within the bits, joining by parts of the code finds enough that no pair of images is lost."""
    originals = pictures(10, 4)
    edits = [media.edited(p, i % 4, i) for i, p in enumerate(originals)]
    described = [media.describe(p.astype(np.float32)) for p in originals], [media.describe(p.astype(np.float32)) for p in edits]
    want = set()
    for q, (qp, qc) in enumerate(described[1]):
        for i, (p, c) in enumerate(described[0]):
            a, b = np.nonzero(np.bitwise_count((qc[:, None, :] ^ c[None, :, :]).view(np.uint64)).sum(2) <= media.BITS)
            if len(a) >= media.AGREE and media.agreeing(qp[a], p[b]) >= media.AGREE:
                want.add((q, i))
    rows = lambda ps: frame(spark, [(i, media.encode_pgm(p)) for i, p in enumerate(ps)])
    got = {(r["query_id"], r["id"]) for r in media.find_copies(rows(originals), rows(edits)).collect()}
    assert len(want & got) >= 0.9 * len(want) and got <= want


def test_consensus():
    rng = np.random.default_rng(0)
    q = np.column_stack([rng.uniform(0, 100, (30, 2)), np.ones(30), np.zeros(30)])
    p = q.copy()
    p[:, :2] = p[:, [1, 0]] * [-1, 1] * 2 + [150, 10]
    p[:, 2], p[:, 3] = 2, np.pi / 2
    p[20:, :2] = rng.uniform(0, 1000, (10, 2))
    assert 20 <= media.agreeing(q, p) <= 22


def test_odd_images(spark):
    good = media.encode_pgm(pictures(1)[0])
    odd = [(1, good), (1, good), (2, None), (3, b""), (4, b"no image"), (5, media.encode_pgm(np.zeros((50, 50)))), (6, media.encode_pgm(np.ones((3, 3)))), (None, good)]
    extra = frame(spark, odd).selectExpr("*", "1 AS id", "2 AS key", "3 AS hi")
    got = media.find_copies(extra, extra)
    assert [(r["query_id"], r["id"]) for r in got.collect()] == [(1, 1)]
    assert media.find_copies(extra.limit(0), extra).count() == 0 and media.descriptors(extra.limit(0)).count() == 0
    counted = sorted((tuple(r)[:4] for r in media.count_copies(extra, extra).collect()), key=str)
    # The null id is no image; both rows of id 1 are copies of both; the icon of one tone and what can't be read are of none.
    assert counted == [(1, 1, 2, 1), (1, 1, 2, 1), *((n, None, 0, 0) for n in range(2, 7))]
    named = media.drawn(spark.createDataFrame([("a", [0.5, 0.1] * 32)], "vec_id string, embedding array<float>"), edit=True)
    assert [r["vec_id"] for r in named.collect()] == ["a"]
    drawn = media.drawn(spark.createDataFrame([(1, [0.5] * 64), (2, None), (3, []), (None, [1.0])], "vec_id bigint, embedding array<float>"))
    assert drawn.where("image IS NULL").count() == 3


def test_corners_grow_with_the_image(spark):
    """An image pasted into a larger one is found, whose strongest corners lie elsewhere."""
    originals = pictures(6, 3)
    rng = np.random.default_rng(5)
    pasted = []
    for p in originals:
        busy = np.kron(rng.integers(0, 2, (40, 40)) * 255, np.ones((8, 8))).astype(np.uint8)
        busy[100:196, 120:216] = p
        pasted.append(busy)
    assert len(media.describe(pasted[0].astype(np.float32))[0]) > 4 * 64
    rows = lambda ps: frame(spark, [(i, media.encode_pgm(p)) for i, p in enumerate(ps)])
    got = {(r["query_id"], r["id"]) for r in media.find_copies(rows(originals), rows(pasted)).collect()}
    assert len({q for q, i in got if q == i}) >= 5


@pytest.mark.parametrize("factor", (0.5, 2.0))
def test_resized_copies_are_found(spark, factor):
    originals = [np.kron(p, np.ones((2, 2), np.uint8)) if factor < 1 else p for p in pictures(4, 6)]
    resized = [media.scaled(p.astype(np.float32), factor).astype(np.uint8) for p in originals]
    rows = lambda ps: frame(spark, [(i, media.encode_pgm(p)) for i, p in enumerate(ps)])
    got = {(r["query_id"], r["id"]) for r in media.find_copies(rows(originals), rows(resized)).collect()}
    assert len({q for q, i in got if q == i}) >= 3


def test_a_third_of_the_size_has_a_level(spark):
    p = np.kron(pictures(1, 6)[0], np.ones((3, 3), np.uint8)).astype(np.float32)
    assert media.describe(p)[0][:, 2].max() > 6


def test_tiny_images_match_their_own_bytes(spark):
    icon = media.encode_pgm(np.arange(64).reshape(8, 8))
    got = media.find_copies(frame(spark, [(1, icon), (2, media.encode_pgm(np.eye(8)))]), frame(spark, [(7, icon)])).collect()
    assert [tuple(r) for r in got] == [(7, 1, 0, 0)]
