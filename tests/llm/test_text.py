"""Operators over texts: brute force, the library, round trips, held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from textmesh.llm import decontam, langid, png_media, simhash, spiece, substring, toxicity
from textmesh.llm.common import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
RNG = random.Random(3)
VOCAB = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(1, 7))) for _ in range(400)]


def text(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def edited(t, at, word="QQQ"):
    w = t.split()
    w[at] = word
    return " ".join(w)


BASE = text(120, 1)
EDGE = [
    (1, BASE), (2, BASE), (3, None), (4, ""), (5, " \t\n "), (6, "one"), (7, "One"), (8, "two words"), (9, "é ü x"), (10, text(60, 2) + "\n" + BASE + " tail"),
    (11, text(30000, 3)), (12, "loop " * 300), (13, "loop " * 70), (1, BASE), (1, "another text of the same id"), (None, BASE), (None, None), (14, edited(BASE, 60)), (15, edited(edited(BASE, 60), 10)), (2**62, text(50, 9)),
]
SCHEMA = "doc_id long, text string, bucket int, payload binary, score double, fp long, lang string, copy string, kept_text string, ids array<int>"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, b"x", 0.5, 7, None, "c", "k", [1]) for i, t in rows], SCHEMA)


def key(x):
    return tuple((v is None, str(v)) for v in x)


# 6: substrings


def brute_removal(rows, window):
    first = {}
    ws = [(np.inf if i is None else i, WORD.findall((t or "").encode())) for i, t in rows]
    for i, w in ws:
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            first[k] = min(first.get(k, np.inf), i)
    out = []
    for (raw, _), (i, w) in zip(rows, ws, strict=True):
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        out.append((raw, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("window", [50, 3, 1])
def test_removal(spark, window, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_WINDOWS", 500)
    out = substring.remove_repeats(frame(spark, EDGE).repartition(3), window)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()), key=key) == brute_removal(EDGE, window)


def test_strip_keeps_columns(spark):
    df = frame(spark, EDGE)
    out = substring.strip_repeats(df)
    assert out.columns == df.columns and out.count() == len(EDGE)
    kept = {r.doc_id: r.text for r in out.where("doc_id in (2, 3, 5, 10)").collect()}
    assert kept == {2: "", 3: None, 5: " \t\n ", 10: text(60, 2) + " tail"}
    assert substring.strip_repeats(df.limit(0)).collect() == [] and substring.remove_repeats(df.limit(0)).collect() == []


# 9: near-duplicates


def plain_fingerprint(t, k=4):
    w = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
    s = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    return [find(x) for x in range(n)]


def brute_components(ids, fps, distance):
    root = union(len(fps), ((a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= distance))
    low = {}
    for i, r in zip(ids, root, strict=True):
        low[r] = min([x for x in (low.get(r), i) if x is not None], default=None)
    return [low[r] for r in root]


def test_simhash(spark):
    rows = EDGE + [(100 + k, edited(text(200, 50), k)) for k in range(30)]
    fps = [plain_fingerprint(t) for _, t in rows]
    low = brute_components([i for i, _ in rows], fps, 4)
    want = sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, low, strict=True)), key=key)
    assert sorted(map(tuple, simhash.near_duplicates(frame(spark, rows)).collect()), key=key) == want
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize(("counts", "distance", "hot", "dense"), [((2,), 4, 50_000, 16), ((3,), 4, 5, 2), ((3,), 4, 50_000, 16), ((4,), 7, 50_000, 4), ((4,), 4, 7, 1), ((3,), 7, 3, 0)])
def test_links_find_every_component(spark, monkeypatch, counts, distance, hot, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    r = random.Random(7)
    fps = {r.getrandbits(64) for _ in range(300)} | {0, 2**64 - 1}
    for f in list(fps)[:60]:
        for _ in range(4):
            g = f
            for b in r.sample(range(64), r.randint(1, distance + 2)):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), distance, hot, counts).collect()
    at = {f: k for k, f in enumerate(signed)}
    assert all((fps[at[e.a]] ^ fps[at[e.b]]).bit_count() <= distance for e in got)
    mine = union(len(fps), [(at[e.a], at[e.b]) for e in got])
    want = union(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= distance])
    groups = lambda root: sorted(sorted(k for k in range(len(fps)) if root[k] == x) for x in set(root))
    assert groups(mine) == groups(want)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 120), r.randint(0, 120)) for _ in range(90)] + [(k, k + 1) for k in range(200, 260)] + [(300, k) for k in range(301, 340)]
    root = union(400, edges)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    low = {x: min(y for y in touched if root[y] == root[x]) for x in touched}
    assert got == low
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates_go(spark):
    rows = [*EDGE, *((200 + k, edited(text(150, 77), 20 * k % 150)) for k in range(5)), (300, text(150, 78)), (301, text(150, 79))]
    out = simhash.drop_near_duplicates(frame(spark, rows))
    assert out.columns == SCHEMA_COLUMNS
    kept = Counter(r.doc_id for r in out.collect())
    # 1 stands for its copies and for 10's similar ones; 3 for all texts without words; 6 and 7 are one text when lower-cased
    assert kept[1] == 3 and kept[2] == kept[14] == kept[15] == kept[4] == kept[5] == kept[7] == kept[None] == 0
    assert all(kept[i] == 1 for i in (3, 6, 8, 9, 10, 11, 200, 300, 301, 2**62)) and not any(kept[200 + k] for k in range(1, 5))
    assert simhash.drop_near_duplicates(frame(spark, rows).limit(0)).collect() == []


def brute_kept(rows, least=0.8):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.lower().split() for _, t in rows)]
    root = union(len(rows), ((a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])))
    return {min(rows[k][0] for k in range(len(rows)) if root[k] == x) for x in set(root)}


def replaced(words_, r, n):
    w = list(words_)
    for k in r.sample(range(len(w)), n):
        w[k] = f"new{r.getrandbits(40)}"
    return " ".join(w)


@pytest.mark.parametrize(("length", "edits"), [(300, 4), (600, 8)])
def test_variants_of_one_text_are_one_group(spark, length, edits):
    r = random.Random(length)
    base = [f"w{r.randrange(5000)}" for _ in range(length)]
    rows = [(k, replaced(base, r, edits)) for k in range(1, 100)] + [(100, " ".join(base))]
    assert {x.doc_id for x in simhash.drop_near_duplicates(frame(spark, rows)).collect()} == brute_kept(rows)


def test_near_copies_are_found_and_decided_exactly(spark):
    r = random.Random(5)
    rows = []
    for k in range(150):
        w = [f"w{r.randrange(20_000)}" for _ in range(r.randint(80, 700))]
        share = r.uniform(0.05, 0.35)
        more = [f"b{r.getrandbits(40)}" for _ in range(int(len(w) * share))]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w + more) if k % 2 else replaced(w, r, max(1, int(len(w) * share / 12))))]
    assert {x.doc_id for x in simhash.drop_near_duplicates(frame(spark, rows)).collect()} == brute_kept(rows)


ODD = ["__index_level_0__", "__copy", "__is_toxic", "__shard", "copy", "kept", "grouped", "key", "marks", "low", "root", "id", "h", "fp", "bands", "__kept_text", "Key_", "p_toxic", "a b", "x`y"]


def odd(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", *(F.lit(k).alias(c) for k, c in enumerate(ODD)), "text", F.length("text").alias("n_chars"))


def test_columns_of_any_name_pass_all_stages(spark):
    import corpus_pipeline as P

    df = odd(spark, [*EDGE, (16, text(90, 5) + " vile"), (17, leak_rows()[0][1]), (18, text(30, 8) + " " + BASE)])
    labels = spark.createDataFrame([(16, 1, 0), (17, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, key int")
    for f in (lambda d: toxicity.drop_toxic(d, labels), simhash.drop_near_duplicates, substring.strip_repeats, lambda d: decontam.drop_contaminated(d, bench)):
        for d in (df, df.limit(0)):
            out = f(d)
            assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString()
            got = out.collect()
            assert all(r["x`y"] == len(ODD) - 1 and r["__copy"] == 1 for r in got) and bool(got) == (d is df)
    for name, stage in P.STAGES[1:3]:
        assert stage(spark, df, None).columns == df.columns, name
    assert spiece.encode_checked(df).count() == df.count() and spiece.encode_checked(df.limit(0)).collect() == []


def test_rows_without_id_that_share_a_passage(spark):
    rows = [(None, f"{text(30, k)} {BASE} {text(20, k + 50)}") for k in range(40)] + [(5, f"{text(9, 200 + k)} {BASE}") for k in range(20)] + [(3, BASE)] * 3
    out = substring.remove_repeats(frame(spark, rows).repartition(5))
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()), key=key) == brute_removal(rows, 50)


SCHEMA_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def test_sketch():
    a, b = np.arange(0, 100, dtype="<u4"), np.arange(10, 110, dtype="<u4")
    assert simhash.similarity(a.tobytes(), b.tobytes()) == 90 / 110 and simhash.similarity(b"", b"") == 1 and simhash.similarity(b"", a.tobytes()) == 0


# 7: images


def plain_feature(samples):
    """The hash by definition: means of 32 x 32 cells, cosine sums, median."""
    from math import cos, pi

    h, w = len(samples), len(samples[0])
    cut = lambda n: [(k * n // 32, max(k * n // 32 + 1, (k + 1) * n // 32)) for k in range(32)]
    small = [[sum(samples[y][x] for y in range(a, b) for x in range(c, d)) / ((b - a) * (d - c)) for c, d in cut(w)] for a, b in cut(h)]
    wave = [[cos(pi / 32 * u * (x + 0.5)) for x in range(32)] for u in range(8)]
    half = [[sum(small[y][x] * wave[v][x] for x in range(32)) for v in range(8)] for y in range(32)]
    low = [round(sum(half[y][v] * wave[u][y] for y in range(32)), 6) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    bits = [x > middle for x in low]
    return f"{int(''.join('01'[b] for b in bits), 2):016x}"


def test_media_query(spark, tmp_path):
    rows = [*EDGE, (501, "héé €" * 99), (502, "a" * 64), (503, "b" * 65), (504, "\n".join(text(30, k) for k in range(40)))]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in png_media.op7_media(spark, str(tmp_path)).collect()), key=key)
    want, used = [], set()
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        samples = [list(payload[a : a + 64]) for a in range(0, len(payload), 64)]
        blob = png_media.encode_png(payload)
        used |= set(png_media.read_chunks(blob)[1].tolist())
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), plain_feature(samples)))
    assert got == sorted(want, key=key) and len(used) > 3


def test_filters_have_the_least_sums():
    rows = np.random.default_rng(8).integers(60, 120, (20, 64), dtype=np.uint8)
    lines = png_media.filtered(rows, np.arange(20) % 7 == 0)
    for k in range(20):
        up = rows[k - 1].astype(int) if k % 7 else np.zeros(64, int)
        left, corner, x = np.concatenate(([0], rows[k][:-1])).astype(int), np.concatenate(([0], up[:-1])), rows[k].astype(int)
        nearest = np.array([min((abs(a + b - c - v), i, v) for i, v in enumerate((a, b, c)))[2] for a, b, c in zip(left, up, corner, strict=True)])
        sums = [np.abs(((x - g + 128) % 256) - 128).sum() for g in (0, left, up, (left + up) // 2, nearest)]
        assert lines[k, 0] == int(np.argmin(sums))


def test_damaged_images():
    import struct

    blob = png_media.encode_png(bytes(range(64)) * 5)
    for at in range(len(blob)):
        for bit in (1, 128):
            with pytest.raises(ValueError):
                png_media.decode_png(blob[:at] + bytes([blob[at] ^ bit]) + blob[at + 1 :])
        with pytest.raises(ValueError):
            png_media.decode_png(blob[:at])
    chunk, sign = png_media._chunk, blob[:8]
    head = struct.pack(">IIBBBBB", 64, 5, 8, 0, 0, 0, 0)
    lines = zlib.compress(b"\0" * 325)
    good = sign + chunk(b"IHDR", head) + chunk(b"tEXt", b"hi") + chunk(b"IDAT", lines[:9]) + chunk(b"IDAT", lines[9:]) + chunk(b"IEND", b"")
    assert not png_media.decode_png(good).any()
    for bad in (
        sign + chunk(b"IHDR", head[:-1]) + chunk(b"IDAT", lines) + chunk(b"IEND", b""), sign + chunk(b"IHDR", head) * 2 + chunk(b"IDAT", lines) + chunk(b"IEND", b""),
        sign + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"\5" * 325)) + chunk(b"IEND", b""), sign + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"\0" * 326)) + chunk(b"IEND", b""),
        sign + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 5, 16, 0, 0, 0, 0)) + chunk(b"IDAT", lines) + chunk(b"IEND", b""), sign + chunk(b"IHDR", head) + chunk(b"ABCD", b"") + chunk(b"IDAT", lines) + chunk(b"IEND", b""),
        sign + chunk(b"IHDR", head) + chunk(b"IEND", b""), sign, b"",
    ):
        with pytest.raises(ValueError):
            png_media.decode_png(bad)
    got = png_media.decode_all([good, None, bad, blob, png_media.encode_png(bytes(range(40)) * 3, width=40)])
    assert [type(x) for x in got] == [np.ndarray, ValueError, ValueError, np.ndarray, np.ndarray] and got[4].tobytes() == bytes(range(40)) * 3


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    data = np.random.default_rng(kind).integers(0, 256, 64 * 41, dtype=np.uint8).tobytes()
    blob = png_media.encode_png(data, line_filter=kind)
    assert png_media.decode_png(blob).tobytes() == data
    for damaged in (blob[:-20], blob[:40] + bytes([blob[40] ^ 1]) + blob[41:], b"GIF" + blob[3:], blob[:8] + blob[33:]):
        with pytest.raises(ValueError):
            png_media.decode_png(damaged)


def test_png_of_mixed_filters():
    rows = np.random.default_rng(1).integers(0, 256, (10, 64), dtype=np.uint8)
    lines = []
    for k in range(10):  # a plain encoder, line by line
        f, up, left = k % 5, rows[k - 1] if k else np.zeros(64, np.uint8), np.concatenate(([0], rows[k][:-1]))
        corner = np.concatenate(([0], up[:-1]))
        guess = [np.zeros(64), left, up, (left.astype(int) + up) // 2, [min((abs(int(a) + int(b) - int(c) - int(v)), i, int(v)) for i, v in enumerate((a, b, c)))[2] for a, b, c in zip(left, up, corner, strict=True)]][f]
        lines.append(bytes([f]) + ((rows[k].astype(int) - np.array(guess).astype(int)) % 256).astype(np.uint8).tobytes())
    raw = np.frombuffer(b"".join(lines), np.uint8).reshape(10, 65)
    assert (png_media.unfilter(raw[:, 0], raw[:, 1:]) == rows).all()


def test_media(spark):
    out = {(r.doc_id, r.n_bytes): r for r in png_media.read_images(png_media.write_images(frame(spark, EDGE))).collect()}
    for i, t in EDGE:
        raw = (t or "").encode()
        r = out[i, len(raw)]
        assert bytes(r.payload) == raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw)) and r.error is None and len(r.feature) == 16
    bad = png_media.write_images(frame(spark, EDGE[:1])).withColumn("media", F.substring("media", 1, 50))
    assert png_media.verify_images(bad).count() == 1
    assert png_media.read_images(png_media.write_images(frame(spark, EDGE).limit(0))).collect() == []


# 10: pieces

TEXTS = ["", " ", "  a  b\n\nc\t d ", "héllo ∂ 𝒳 the</s>", "a" * 3000, "the" * 300, " " * 77 + "x", *(t or "" for _, t in EDGE), *("".join(random.Random(k).choice("abcdeABC ,.  \n\té中文字𝒳€09<>/") for _ in range(120)) for k in range(150))]


def test_bpe_gives_the_library_ids():
    m, lib = spiece.load().prepare(), sentencepiece.SentencePieceProcessor(model_file=spiece.MODEL)
    at, ids = m.encode(TEXTS)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == lib.encode(TEXTS)
    assert m.decode(at, ids.astype(np.int64)) == TEXTS == lib.decode(lib.encode(TEXTS))


def test_long_words_are_searched_in_blocks():
    r = random.Random(21)
    chinese = "".join(chr(r.randint(0x4E00, 0x4E00 + 400)) for _ in range(4000))
    plain = "".join(r.choice(VOCAB) for _ in range(3000))
    texts = [chinese, plain, "a" * 1000, "ab" * 777, "x" + "the" * 500, plain[:97], plain[:193], plain[:128] + "𝒳" * 70 + plain[:200], "http" + "s" * 300 + plain[:40], *(plain[k : k + 96 + 13 * k] for k in range(1, 20))]
    m, lib = spiece.load().prepare(), sentencepiece.SentencePieceProcessor(model_file=spiece.MODEL)
    at, ids = m.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == lib.encode(texts)
    assert m.merged < 0.1 * sum(map(len, texts))


def test_remembered_words(monkeypatch):
    monkeypatch.setattr(spiece, "MEMORY", 60)
    m, lib = spiece.load().prepare(), sentencepiece.SentencePieceProcessor(model_file=spiece.MODEL)
    for k in range(20):
        part = TEXTS[k % 7 :: 7] + [text(20, k // 2)]
        at, ids = m.encode(part)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == lib.encode(part)
    monkeypatch.setattr(spiece, "MEMORY", 1 << 22)
    for part in (TEXTS, TEXTS[::-1], TEXTS):
        at, ids = m.encode(part)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == lib.encode(part)
    assert len(m.met) == len(m.met_at) == len(m.met_n) and (np.diff(m.met.astype(object)) > 0).all()


def _field(number, kind, value):
    head = bytes([number << 3 | kind])
    return head + (bytes([len(value) & 127 | 128, len(value) >> 7]) + value if kind == 2 else value)


def unigram_model(byte_fallback):
    """A small unigram model made of pieces with known scores."""
    import struct

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if byte_fallback:
        pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    r = random.Random(2)
    words = {"▁", *"abcdefgh", "▁a", "ab", "abc", "▁abc", "cde", "efgh", "▁▁", "hé"} | {"".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5))) for _ in range(80)}
    pieces += [(w, -1.0 - r.random() * 8, 1) for w in sorted(words)]
    body = b"".join(_field(1, 2, _field(1, 2, p.encode()) + _field(2, 5, struct.pack("<f", s)) + _field(3, 0, bytes([t]))) for p, s, t in pieces)
    trainer = _field(3, 0, b"\x01") + bytes([35 << 3 & 127 | 128, 35 << 3 >> 7, int(byte_fallback)])
    return body + _field(2, 2, trainer) + _field(3, 2, _field(1, 2, b"identity") + _field(3, 0, b"\x01") + _field(4, 0, b"\x00"))


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_gives_the_library_ids(fallback):
    blob = unigram_model(fallback)
    m, lib = spiece.Model(blob).prepare(), sentencepiece.SentencePieceProcessor(model_proto=blob)
    texts = ["abc", "abcdefgh  ab", "", "zz ab z", "hé é", *("".join(random.Random(k).choice("abcdefgh  é") for _ in range(40)) for k in range(200))]
    at, ids = m.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == lib.encode(texts)


def test_pieces_in_spark(spark):
    df = frame(spark, EDGE)
    tokens = spiece.encode(df)
    assert sorted(map(tuple, spiece.decode(tokens).collect()), key=key) == sorted(((i, t or "") for i, t in EDGE), key=key)
    out = spiece.digest(df).collect()
    assert all(r.round_trip for r in out) and {r.doc_id: r.n_tokens for r in out}[4] == 0
    assert [r.text for r in spiece.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()] == [None]
    assert spiece.digest(df.limit(0)).collect() == []


# 3: benchmark items

ITEMS = [(1, text(20, 31) + "\n" + text(9, 32)), (2, text(40, 33)), (3, "four little words here"), (4, None), (5, ""), (6, text(40, 33)), (7, text(300, 34) + "\n" + text(20, 35) + "\n" + text(3, 36))]


def leak_rows():
    q1 = ITEMS[0][1]
    hidden = lambda t, n: text(n, 900 + n) + " " + t + " " + text(n, 901 + n)
    return [
        (1, hidden(q1.upper(), 100), [1]), (2, hidden(q1.split("\n")[0], 70), []), (3, hidden(ITEMS[1][1].replace(" ", ",  "), 333), [2, 6]), (4, "so, FOUR little\nwords here!", [3]), (5, text(5000, 40), []),
        (6, hidden(ITEMS[6][1], 291), [7]), (7, hidden(" ".join(sorted(ITEMS[1][1].split())), 10), []), (8, None, []), (9, "", []), (None, ITEMS[1][1], [2, 6]), (3, hidden(ITEMS[1][1].replace(" ", ",  "), 333), [2, 6]),
        (10, text(700, 41) + " " + q1 + " " + ITEMS[1][1], [1, 2, 6]),
    ]


def test_decontamination(spark):
    bench = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, score int")
    rows = leak_rows()
    df = frame(spark, [(i, t) for i, t, _ in rows])
    got = sorted(((r.doc_id, r.item_ids, r.contaminated) for r in decontam.find(df, bench).collect()), key=key)
    assert got == sorted(((i, w, bool(w)) for i, _, w in rows), key=key)
    kept = decontam.drop_contaminated(df, bench)
    assert kept.columns == SCHEMA_COLUMNS and sorted((r.doc_id for r in kept.collect()), key=str) == [2, 5, 7, 8, 9]
    assert decontam.find(df.limit(0), bench).collect() == [] and not any(r.contaminated for r in decontam.find(df, bench.limit(0)).collect())


def plain_bm25(items, docs, threshold):
    """All passages and items at the threshold, by counting words."""
    from math import log

    split = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    bags = {i: Counter(split(t)) for i, t in items}
    size = {i: sum(b.values()) for i, b in bags.items()}
    mean = sum(size.values()) / len(size)
    df = Counter(w for b in bags.values() for w in b)
    weight = {i: {w: log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size[i] / mean)) for w, n in b.items()} for i, b in bags.items()}
    out = {}
    longest = {}
    for n in size.values():
        c = (n - 1).bit_length()
        longest[c] = max(longest.get(c, 0), n)
    at = 0
    for k, d in enumerate(docs):
        ws = split(d)
        for c, seg in longest.items():
            for a in range(0, len(ws), seg):
                own = set(ws[a : a + 2 * seg])
                for i in bags:
                    if (size[i] - 1).bit_length() == c:
                        s = sum(v for w, v in weight[i].items() if w in own) / sum(weight[i].values())
                        if s >= threshold - 1e-9:
                            out[k, i, at + a] = s
        at += len(ws)
    return out


@pytest.mark.parametrize(("threshold", "step"), [(0.3, 1 << 21), (0.5, 300), (0.9, 1), (0.15, 5000)])
def test_pruned_search_retrieves_all(monkeypatch, threshold, step):
    """The opened blocks give the items that a full BM25 scan gives, and are few."""
    monkeypatch.setattr(decontam, "STEP", step)
    items = [(k, text(random.Random(k).choice([1, 2, 3, 7, 8, 9, 20, 40, 41]), 500 + k)) for k in range(120)]
    index = decontam.Index(items, threshold=threshold)
    docs = [text(500, 700 + k) + " " + items[k][1] for k in range(12)] + ["", "x", items[5][1]]
    raw = [d.encode() for d in docs]
    off = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    doc, h = decontam.terms(np.frombuffer(b"".join(raw), np.uint8), off)
    got = {(int(d), int(index.ids[i]), int(a)): float(s) for d, i, s, a, _ in zip(*index.search(doc, h, len(docs)), strict=True)}
    want = plain_bm25(items, docs, threshold)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_blocks_are_skipped():
    r = random.Random(9)
    words_ = [f"w{k}" for k in range(20_000)]
    items = [(k, " ".join(r.choice(words_) for _ in range(r.randint(15, 40)))) for k in range(2000)]
    docs = [" ".join(r.choice(words_) for _ in range(400)) + " " + items[k][1] for k in range(20)]
    index, raw = decontam.Index(items), [d.encode() for d in docs]
    doc, h = decontam.terms(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))))
    found = index.search(doc, h, len(docs))
    assert {(int(d), int(index.ids[i])) for d, i in zip(found[0], found[1], strict=True)} >= {(k, k) for k in range(20)}
    assert index.scored[0] < 0.01 * len(items) * len(h) / 40


def test_too_many_items_are_refused(spark, monkeypatch):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for name in ("MAX_ITEMS", "MAX_BYTES"):
        monkeypatch.setattr(decontam, name, 3)
        with pytest.raises(ValueError, match="in parts"):
            decontam.build(bench)
        monkeypatch.setattr(decontam, name, 1000)


# 8 and 1: classifiers


def test_language(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.op8_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 100 and sum(r.lang_pred == r.lang for r in out) > 0.95 * len(out) and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)


def test_language_edges(spark):
    rows = [(i, t, None) for i, t in EDGE] + [(400, "12 34 !?", "xx"), (401, "ß", None), (402, "und das ist gut " * 5, "de"), (403, "and this is good " * 5, "en"), (403, "and this is good " * 5, "en"), (404, "the thing is this", None), (406, "das ist und", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    out = langid.identify(df, F.lit(True)).collect()
    pred = {r.doc_id: r.lang_pred for r in out}
    assert len(out) == len(rows) and all(pred[i] == "und" for i in (3, 4, 5, 400)) and pred[401] != "und" and pred[404] == "en" and pred[406] == "de"
    assert all(r.score == 0 for r in out if r.lang_pred == "und")
    none = langid.identify(df.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).collect()
    assert len(none) == len(rows) and all(r.lang_pred == "und" for r in none)
    assert langid.identify(df.limit(0), F.lit(True)).collect() == []


def test_kernel_rows():
    texts = [b"abca", b"abd", b"xyz abc", b"ABD q"]
    k = langid.Kernel(texts)
    f = lambda t: {(n, t[i : i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    sets = [f(t.lower()) for t in texts]
    shared = {g for g in set().union(*sets) if sum(g in s for s in sets) >= 2}
    want = [[len(a & b & shared) / np.sqrt(max(1, len(a & shared)) * max(1, len(b & shared))) for b in sets] for a in sets]
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    assert np.allclose(k.rows(np.frombuffer(b"".join(texts), np.uint8), off), want, atol=1e-6)


def test_kernel_rows_in_parts(monkeypatch):
    texts = [text(60, k).encode() for k in range(9)]
    k, buf = langid.Kernel(texts), np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    want = k.rows(buf, off)
    monkeypatch.setattr(langid, "STEP_BYTES", 37)
    assert (k.rows(buf, off) == want).all()


def plain_language(texts, labels, asked, ridge):
    """One-versus-rest kernel ridge over Nystroem features, by definition."""
    spectrum = lambda t: {(n, t[i : i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    low = lambda t: t.encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
    marks = [spectrum(low(t)) for t in texts]
    shared = {g for g in set().union(*marks) if sum(g in m for m in marks) >= 2}
    kernel = lambda a, b: len(a & b & shared) / np.sqrt(max(1, len(a & shared)) * max(1, len(b & shared)))
    own = np.array([[kernel(a, b) for b in marks] for a in marks])
    value, vector = np.linalg.eigh(own)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    x = np.column_stack((own @ root, np.ones(len(marks))))
    names = sorted(set(labels))
    y = np.array([[1.0 if v == n else -1.0 for n in names] for v in labels])
    w = np.linalg.lstsq(np.vstack((x, np.sqrt(ridge) * np.eye(x.shape[1]))), np.vstack((y, np.zeros((x.shape[1], len(names))))), rcond=None)[0]
    out = []
    for t in asked:
        z = np.append(np.array([kernel(spectrum(low(t)), m) for m in marks]) @ root, 1.0) @ w
        out.append((names[int(z.argmax())], min(1.0, max(0.0, (1 + z.max()) / 2))))
    return out


def test_language_against_plain_code(spark):
    r = random.Random(31)
    kinds = {"aa": "abcde ", "bb": "cdefg ", "cc": "aegxy "}
    known = [(k, "".join(r.choice(c) for _ in range(r.randint(5, 60))) + "a", v) for k, (v, c) in enumerate(list(kinds.items()) * 12)]
    asked = [(100 + k, "".join(r.choice(r.choice(list(kinds.values()))) for _ in range(30)) + "A") for k in range(20)]
    df = spark.createDataFrame([*known, *((i, t, None) for i, t in asked)], "doc_id long, text string, lang string")
    got = {x.doc_id: (x.lang_pred, x.score) for x in langid.identify(df, F.lit(True)).collect()}
    want = plain_language([t for _, t, _ in known], [v for *_, v in known], [t for _, t in asked], langid.RIDGE)
    for (i, _), (v, s) in zip(asked, want, strict=True):
        assert got[i][1] == pytest.approx(s, abs=2e-3) and (got[i][0] == v or abs(s - 0.5) < 0.05)


def test_kernel_keeps_all_shared_grams():
    r = np.random.default_rng(3)
    text = r.integers(128, 256, 150_000, dtype=np.uint8)
    k = langid.Kernel([text.tobytes()] * 2)
    assert k.width == sum(len(np.unique(langid.grams(text, np.array([0, len(text)]), n)[1])) for n in (1, 2, 3)) > 100_000
    assert k.rows(np.tile(text, 3), np.arange(4) * len(text)) == pytest.approx(np.ones((3, 2)), abs=1e-3)


def test_toxicity_of_documents_not_learnt_from(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    out = toxicity.classify(docs.where(held), labels, train_docs=docs.where(~held)).join(labels, "doc_id").collect()
    toxic = [r for r in out if r.toxic]
    assert len(toxic) > 100 and sum(r.is_toxic for r in toxic) >= 0.9 * len(toxic) and sum(r.is_toxic for r in out if not r.toxic) <= 0.01 * len(out)


def plain_chain(texts, labels, folds):
    """The classifier chain with dictionaries and gradient steps of a general
    solver instead of arrays and Newton's method."""
    from math import exp

    docs = [set(re.findall(r"[a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))) for t in texts]

    def fit(rows, earlier, y):
        n, n1 = len(rows), sum(y)
        if n1 in (0, n):
            return lambda d, e: 30.0 if n1 else -30.0
        z = {}
        for w in sorted(set().union(*rows)):
            a, b = sum(w in r for r, v in zip(rows, y, strict=True) if v), sum(w in r for r in rows)
            pool = b / n
            if b >= min(toxicity.SEEN, n):
                z[w] = abs(a / n1 - (b - a) / (n - n1)) / max(pool * (1 - pool) * (1 / n1 + 1 / (n - n1)), 1e-12) ** 0.5
        words_ = [w for w in z if z[w] >= toxicity.LEAST_Z]
        assert len(words_) <= toxicity.WORDS
        x = np.array([[float(w in r) for w in words_] + list(e) + [1.0] for r, e in zip(rows, earlier, strict=True)])
        target, k = np.array(y, float), x.shape[1]
        ridge = np.array([toxicity.RIDGE] * (k - 1) + [1e-6])
        w = np.zeros(k)
        step = 1 / (0.25 * np.linalg.norm(x, 2) ** 2 + toxicity.RIDGE)
        v, last = w.copy(), w.copy()
        for i in range(20_000):  # accelerated gradient steps
            last, w = w, v - step * (x.T @ (1 / (1 + np.exp(-(x @ v))) - target) + ridge * v)
            v = w + i / (i + 3) * (w - last)
        return lambda d, e: float(sum(c for u, c in zip(words_, w, strict=False) if u in d) + np.dot(w[len(words_) : -1], e) + w[-1])

    sigmoid = lambda s: 1 / (1 + exp(-max(-30, min(30, s))))
    out_of_fold, final = [()] * len(texts), [()] * len(texts)
    for c in range(len(labels[0])):
        y = [row[c] for row in labels]
        whole = fit(docs, out_of_fold, y)
        by_fold = [fit([d for d, f in zip(docs, folds, strict=True) if f != k], [e for e, f in zip(out_of_fold, folds, strict=True) if f != k], [v for v, f in zip(y, folds, strict=True) if f != k]) for k in range(toxicity.FOLDS)]
        out_of_fold = [(*e, sigmoid(by_fold[f](d, e))) for d, e, f in zip(docs, out_of_fold, folds, strict=True)]
        final = [(*e, sigmoid(whole(d, e))) for d, e in zip(docs, final, strict=True)]
    return final


def test_chain_against_plain_code(spark):
    r = random.Random(12)
    rows, labels = [], []
    for k in range(150):
        low, toxic = r.random() < 0.4, r.random() < 0.3
        t = " ".join(r.choice(VOCAB[:60]) for _ in range(25)) + (" Junk! junk spam" if low and r.random() < 0.9 else "") + (" nasty, vile" if toxic and r.random() < 0.8 else "") + (" spam" if toxic and r.random() < 0.5 else "")
        rows.append((k, t))
        labels.append((k, int(not low), int(toxic)))
    out = toxicity.classify(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).orderBy("doc_id").collect()
    folds = [int(toxicity.mix64(np.array([k], np.uint64))[0] % np.uint64(toxicity.FOLDS)) for k in range(150)]
    want = plain_chain([t for _, t in rows], [(1 - q, t) for _, q, t in labels], folds)
    got = [(x.p_low_quality, x.p_toxic) for x in out]
    assert np.allclose(got, want, atol=2e-3) and sum(x.is_toxic for x in out) > 10


def test_chain_uses_earlier_categories():
    r = np.random.default_rng(1)
    y1 = r.integers(0, 2, 600)
    y2 = np.where(r.random(600) < 0.95, y1, 1 - y1)
    h = np.concatenate([[10 + y, *sorted(r.integers(100, 130, 3))] for y in y1]).astype(np.uint64)
    models, cuts, p = toxicity.fit_chain(np.full(600, 4), h, np.column_stack((y1, y2)), np.arange(600) % 3)
    assert models[1].extra.shape == (1,) and models[1].extra[0] > 0 and ((p[:, 1] > 0.5) == y2).mean() > 0.9 and 0 < cuts[0] < 1


def test_threshold_needs_precision():
    r = np.random.default_rng(3)
    p, y = r.random(200), (r.random(200) < 0.1).astype(float)
    assert toxicity._best_threshold(p, y) == 0.5 or ((p >= toxicity._best_threshold(p, y)) @ y) >= 0.9 * (p >= toxicity._best_threshold(p, y)).sum()
    assert toxicity._best_threshold(np.array([0.1, 0.2, 0.6, 0.7]), np.array([0, 0, 1, 1.0])) == pytest.approx(0.4)


def test_out_of_fold_probabilities_dont_leak():
    r = np.random.default_rng(2)
    y = r.integers(0, 2, 300)
    h = np.concatenate([np.sort(r.choice(np.arange(1000, 1400), 40, replace=False)) for _ in range(300)]).astype(np.uint64)
    _, _, p = toxicity.fit_chain(np.full(300, 40), h, y[:, None], np.arange(300) % 3)
    assert abs(((p[:, 0] > 0.5) == y).mean() - 0.5) < 0.12  # pure noise stays noise


def test_all_words_of_long_documents_are_learnt(spark):
    names = ["".join(chr(97 + int(c)) for c in f"{k:05d}") for k in range(6000)]
    buf = np.frombuffer(" ".join(names).encode(), np.uint8)
    h = toxicity.letter_words(buf, np.array([0, len(buf)]))[1]
    last = int(np.argmax(h))
    filler = " ".join(names[:last] + names[last + 1 :])
    df = frame(spark, [(k, f"{filler} {names[last]}" if k % 2 else filler) for k in range(60)])
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(60)], "doc_id long, quality int, toxic int")
    models, _ = toxicity.train(df, labels)
    assert h[last] in models[1].words


def test_toxicity_is_fitted_away_from_the_driver(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kind, came = type(docs), []
    real = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: [came.append(sum(len(v) for v in r if isinstance(v, (bytes, bytearray, str)))) or r for r in real(self)])
    models, cuts = toxicity.train(docs, labels)
    assert len(models) == len(cuts) == 2 and len(models[1].words) and sum(came) < 50_000


def test_toxicity_edges(spark):
    df = frame(spark, EDGE)
    few = spark.createDataFrame([(1, 1, 1), (2, None, 1), (6, 1, 0), (6, 1, 0), (99, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (few, few.limit(0)):
        out = toxicity.classify(df, labels).collect()
        assert len(out) == len(EDGE) and all(0 <= r.p_toxic <= 1 for r in out)
    assert toxicity.drop_toxic(df, few.limit(0)).columns == SCHEMA_COLUMNS and toxicity.drop_toxic(df, few.limit(0)).count() == len(EDGE)
    assert toxicity.classify(df.limit(0), few).collect() == []
