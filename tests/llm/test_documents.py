"""Each operator on documents against a plain version, on a whole small table and on odd rows."""

import hashlib
import itertools
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from binfold.llm import jpeg, lattice, mergecount, neardup, packing, resample, sstable, toxicity, wordcache
from binfold.llm.queries import op1_gumbel_segmentations, op8_jpeg_media, tokenizer
from tests.llm.conftest import ROWS

WORDS, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer(WORDS))


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer(PIECES))


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def key(r):
    return str((r["doc_id"] is None, r["doc_id"], r["text"]))


# the word tokenizer


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from(list("aAbB'sé.,! \n\t<|>İΣ́ẙZ09")), max_size=40), max_size=4))
def test_chunks_give_the_library_s_ids(library, texts):
    own = wordcache.word_tokenizer(tokenizer(WORDS))
    ids, n = own.encode(texts, 2)
    assert ids.tolist() == [i for x in texts for i in ids_of(library, x)] and n.sum() == len(ids)


def test_a_small_cache_forgets_and_stays_right(library):
    own = wordcache.WordTokenizer(tokenizer(WORDS), cache=3)
    for text in ("one two three four five", "one, two. six <|endoftext|>x", "seven one"):
        assert own.encode([text])[0].tolist() == ids_of(library, text)[:-1]


# op 1


def test_samples_follow_the_lattice_s_law():
    own = lattice.Lattices(tokenizer(PIECES))
    text = "▁a▁cat"
    law = {}
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
        parts = [own.share.get(text[a:b]) for a, b in zip(at, at[1:])]
        if all(parts):
            law[tuple(i for _, i in parts)] = math.prod(s for s, _ in parts)
    total = sum(law.values())
    n = 3000
    got = lattice.sample(own, list(range(n)), ["a cat"] * n, 3)
    first = Counter(tuple(own.ids(s[0]["edges"]).tolist()) for s in got)
    for ids, w in law.items():
        assert abs(first[ids] / n - w / total) < 0.04
    for s in got:
        assert len({tuple(own.ids(x["edges"]).tolist()) for x in s}) == 3
        assert [x["score"] for x in s] == sorted((x["score"] for x in s), reverse=True)
        for x in s:
            assert math.isclose(x["log_prob"], math.log(law[tuple(own.ids(x["edges"]).tolist())] / total), abs_tol=1e-6)
    # by their inclusion scores the samples stand for all segmentations
    weighted = np.mean([sum(math.exp(-x["log_inclusion"]) for x in s) for s in got])
    assert abs(weighted - len(law)) < 0.2 * len(law)


def test_few_segmentations_come_out_whole():
    own = lattice.Lattices(tokenizer(PIECES))
    (s,) = lattice.sample(own, [4], ["a"], 50)
    assert len(s) == 2 and {x["log_inclusion"] for x in s} == {0.0}
    (s,) = lattice.sample(own, [4], [""], 5)
    assert len(s) == 1 and len(s[0]["edges"]) == 0 and s[0]["log_prob"] == 0


def test_words_shared_by_plain_and_odd_texts_keep_their_lattices(monkeypatch):
    blocks = [["the cat", "a  b the cat", " the cat"], ["some other words", "the cat sat"], [" more of other words", "words the end"]]
    fresh = [[[own.ids(x["edges"]).tolist() for x in s] for s in lattice.sample(own, list(range(len(b))), b, 2)] for b in blocks for own in [lattice.Lattices(tokenizer(PIECES))]]
    for edges in (lattice.CACHE_EDGES, 0):  # 0: every block clears the cache
        monkeypatch.setattr(lattice, "CACHE_EDGES", edges)
        own = lattice.Lattices(tokenizer(PIECES))
        for texts, want in zip(blocks, fresh):
            got = [[own.ids(x["edges"]).tolist() for x in s] for s in lattice.sample(own, list(range(len(texts))), texts, 2)]
            assert got == want and [[own.decode(x) for x in s] for s in got] == [[t] * 2 for t in texts]
            assert len(own.known) == len(own.base) == len(own.size)


def test_segmentations_of_the_whole_table(spark, table, pieces):
    """op1's query on the table: distinct segmentations into pieces of the vocabulary that the library decodes to the text, best first, with their plain log-probability."""
    texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    by = defaultdict(list)
    for r in op1_gumbel_segmentations(spark, "/root/testdata/sf0.001").collect():
        by[r["doc_id"]].append(r)
    assert by.keys() == texts.keys()
    ordinary = [i for i in range(pieces.get_piece_size()) if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i) or pieces.is_unused(i))]
    rank = {i: r for r, i in enumerate(sorted(ordinary, key=lambda i: (-pieces.get_score(i), i)))}
    spelt = [" " if i not in rank else pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
    for doc, rows in by.items():
        rows.sort(key=lambda r: r["sample"])
        assert [r["sample"] for r in rows] == list(range(1, len(rows) + 1)) and (len(rows) == 3 or len(texts[doc]) < 8)
        assert len({tuple(r["ids"]) for r in rows}) == len(rows)
        assert all(a["score"] > b["score"] for a, b in itertools.pairwise(rows))
        for r in rows:
            assert r["round_trip"] and pieces.decode(r["ids"]) == texts[doc] and r["n_pieces"] == len(r["ids"]) and r["ids_crc32"] == crc(r["ids"])
            assert all(i in rank or pieces.is_byte(i) for i in r["ids"]) and r["log_inclusion"] <= 0
            if all(i in rank for i in r["ids"]):
                assert "".join(spelt[i] for i in r["ids"]) == "▁" + texts[doc].replace(" ", "▁") or not texts[doc]
        # a segmentation's log-probability less another's is that of their pieces' weights
        plain = [r for r in rows if all(i in rank for i in r["ids"])]
        for a, b in itertools.pairwise(plain):
            weight = lambda r: sum(-0.25 * math.log(rank[i] + 2.7) for i in r["ids"])
            total = math.log(sum(1 / (i + 2.7) for i in range(len(rank))) + 256 / (len(rank) + 2.7)) * 0.25
            want = weight(a) - weight(b) - total * (len(a["ids"]) - len(b["ids"]))
            assert a["log_prob"] - b["log_prob"] == pytest.approx(want, abs=1e-6 * max(1, len(a["ids"])))



def test_sampling_documents(spark, odd, none, pieces):
    model = tokenizer(PIECES)
    rows = lattice.decode(lattice.encode(odd, model, k=2), model).collect()
    texts = defaultdict(set)
    for d, text, *_ in ROWS:
        texts[d].add((text or "").replace("▁", " "))
    assert len({r["doc_id"] for r in rows}) == len(texts)
    for r in rows:
        assert r["decoded"] in texts[r["doc_id"]] and r["n_pieces"] == len(r["ids"]) and r["ids_crc32"] == crc(r["ids"])
        assert r["round_trip"] == ("▁" not in (ROWS[10][1] if r["doc_id"] == 9 else ""))
        assert pieces.decode(r["ids"]).strip(" ") == r["decoded"].strip(" ")
    again = lattice.encode(odd.repartition(3), model, k=2, with_ids=False).collect()
    assert sorted(str((r["doc_id"], r["sample"], r["ids_crc32"])) for r in again) == sorted(str((r["doc_id"], r["sample"], r["ids_crc32"])) for r in rows)
    assert lattice.encode(none, model).count() == 0


# op 2


def test_shards(spark, table, library):
    docs = sorted(table.collect(), key=lambda r: r["doc_id"])
    manifest = sstable.write_shards(table, tokenizer(WORDS), shard_bytes=50_000)
    assert manifest.count() > 4
    got = {r["doc_id"]: r for r in sstable.read_shards(manifest).collect()}
    start = 0
    for d in docs:
        ids = ids_of(library, d["text"])
        r = got[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    for d in docs[::40]:
        (ids,) = sstable.lookup(manifest, d["doc_id"])
        assert ids.tolist() == ids_of(library, d["text"])
    assert sstable.lookup(manifest, -5) == [] == sstable.lookup(manifest, None)


def test_shards_of_odd_rows(spark, odd, none, library):
    manifest = sstable.write_shards(odd, tokenizer(WORDS))
    got = sorted(sstable.read_shards(manifest).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x or 0))
    assert sorted(r["n_tokens"] for r in got) == sorted(len(ids_of(library, r[1])) for r in ROWS)
    assert len(sstable.lookup(manifest, 7)) == 2 == len(sstable.lookup(manifest, None))
    assert sstable.read_shards(sstable.write_shards(none, tokenizer(WORDS))).count() == 0


def test_a_broken_block_is_noticed(tmp_path):
    path = str(tmp_path / "x.sst")
    with pa.OSFile(path, "wb") as sink:
        w = sstable.ShardWriter(sink, 2)
        for i in range(1000):
            w.add(sstable.key_bytes(i - 500), np.arange(i, dtype=np.uint32))
        info = w.finish()
    assert info["n_docs"] == 1000 and sstable.key_id(info["first_key"]) == -500
    data = bytearray(open(path, "rb").read())
    shard = sstable.Shard(pa.BufferReader(bytes(data)))
    assert shard.get(-1)[0].tolist() == list(range(499)) and shard.get(7777) == []
    assert sum(shard.may_hold(sstable.key_bytes(i)) for i in range(10_000, 12_000)) < 100
    data[20] ^= 255
    with pytest.raises(ValueError):
        list(sstable.Shard(pa.BufferReader(bytes(data))))


# op 3


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(list("aeinorst ñé中\n▁.😀1")), max_size=60))
def test_counts_agree_with_the_library(pieces, text):
    assert mergecount.counter(tokenizer(PIECES)).count([text]) == [len(pieces.encode(text))]


def test_counting_documents(spark, odd, table, none, pieces):
    for docs in (table, odd):
        want = sorted(str((r["doc_id"], len((r["text"] or "").encode()), len(pieces.encode(r["text"] or "")))) for r in docs.collect())
        got = mergecount.count_tokens(docs, tokenizer(PIECES)).collect()
        assert sorted(str((r["doc_id"], r["n_bytes"], r["n_tokens"])) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)
    assert mergecount.count_tokens(none, tokenizer(PIECES)).count() == 0


def test_long_sequences_merge_in_the_same_order(pieces):
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcdeting"), 3000))
    assert mergecount.counter(tokenizer(PIECES)).count([text, "a" * 5000]) == [len(pieces.encode(text)), len(pieces.encode("a" * 5000))]


# op 8


@settings(max_examples=60, deadline=None)
@given(payload=st.lists(st.binary(min_size=1, max_size=700), min_size=1, max_size=3))
def test_any_bytes_survive(payload):
    padded = [p + b"\0" * (-len(p) % 192) for p in payload]
    media = jpeg.encode_payloads(b"".join(padded), list(map(len, padded)))
    assert [p for p, _ in jpeg.read_media(media)] == padded


def test_media_columns(spark, odd, none):
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(77, "y" * (192 * 8300))], "doc_id long, text string"))
    want = []
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        p = raw + b" " * (-len(raw) % 192 if raw else 192)
        want.append(str((r["doc_id"], len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))))
    media = jpeg.encode(docs)
    got = jpeg.features(media).collect()
    assert sorted(str((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"])) for r in got) == sorted(want)
    stored = {(r["doc_id"], len(r["media"]), hashlib.sha256(r["media"]).hexdigest()) for r in media.collect()}
    assert {(r["doc_id"], r["media_bytes"], r["media_sha256"]) for r in got} == stored
    big = next(r for r in got if r["doc_id"] == 77)
    assert (big["width"], big["height"]) == (1536, 8300 * 8)
    assert jpeg.features(jpeg.encode(none)).count() == 0


def test_markers_are_checked():
    (good,) = jpeg.encode_payloads(b"q" * 192, [192])
    image = jpeg.Image(good, 0)
    assert (image.width, image.height, image.interval, image.step) == (1536, 8, 192, 8)
    for bad in (b"\0" + good, good.replace(b"\xff\xc0", b"\xff\xc2"), good[:2] + b"\0" + good[3:]):
        with pytest.raises(ValueError):
            jpeg.Image(bad, 0)


def other_image(levels, wide, high, sampling=(1, 1), colour=False, interval=0, step=16, ac=False):
    """A baseline image by another, plain writer: luminance levels by block, flat colours, a code of 5 bits for each size."""
    across, down = sampling if colour else (1, 1)
    units_wide, units_high = -(-wide // across), -(-high // down)
    bits, out, last, units = "", [], [0, 0, 0], 0

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        out.append(b"".join(bytes([int(bits[i : i + 8], 2)]) + b"\0" * (bits[i : i + 8] == "1" * 8) for i in range(0, len(bits), 8)))
        bits = ""

    def block(c, dc):
        nonlocal bits
        d, last[c] = dc - last[c], dc
        n = abs(d).bit_length()
        bits += f"{n:05b}" + (f"{d if d > 0 else d + (1 << n) - 1:0{n}b}" if n else "")
        bits += "00001" + "1" if ac else ""  # a coefficient of size 1
        bits += "00000"

    for y in range(units_high):
        for x in range(units_wide):
            if interval and units and units % interval == 0:
                flush()
                out.append(b"\xff" + bytes([0xD0 + (units // interval - 1) % 8]))
                last = [0, 0, 0]
            for v in range(down):
                for h in range(across):
                    r, c = min(y * down + v, high - 1), min(x * across + h, wide - 1)
                    block(0, levels[r * wide + c])
            for c in (1, 2) if colour else ():
                block(c, 3 * c)
            units += 1
    flush()
    five = lambda n: bytes([0, 0, 0, 0, n] + [0] * 11)
    parts = [(1, across << 4 | down, 0), *(((2, 0x11, 1), (3, 0x11, 1)) if colour else ())]
    return (
        b"\xff\xd8"
        + jpeg._segment(0xFE, b"a comment")
        + jpeg._segment(0xDB, b"\0" + bytes([step] + [1] * 63) + b"\1" + bytes([9] * 64))
        + jpeg._segment(0xC0, struct.pack(">BHHB", 8, high * 8 - 3, wide * 8 - 5, len(parts)) + b"".join(map(bytes, parts)))
        + jpeg._segment(0xC4, b"\0" + five(12) + bytes(range(12)) + b"\x10" + five(2) + bytes([0, 1]))
        + (jpeg._segment(0xDD, struct.pack(">H", interval)) if interval else b"")
        + jpeg._segment(0xDA, bytes([len(parts)]) + b"".join(bytes([p[0], 0]) for p in parts) + b"\0\x3f\0")
        + b"".join(out)
        + b"\xff\xd9"
    )


def test_images_of_other_writers():
    """Colour with any sampling, no restart intervals, short last ones, other tables and steps, and what is no image, side by side with our own."""
    rng = np.random.default_rng(9)
    cases, own = [], jpeg.encode_payloads(b"own payload ".ljust(192), [192])[0]
    for kind in ({}, {"interval": 3}, {"colour": True}, {"colour": True, "sampling": (2, 2), "interval": 2}, {"colour": True, "sampling": (2, 1), "ac": True}, {"ac": True, "step": 3}):
        wide, high = int(rng.integers(1, 8)), int(rng.integers(1, 8))
        levels = rng.integers(-40, 40, wide * high).tolist()
        want = bytes(int(np.clip((v * kind.get("step", 16) + 4 >> 3) + 128, 0, 255)) for v in levels)
        cases += [(other_image(levels, wide, high, **kind), want), (own, b"own payload ".ljust(192))]
    cut = cases[0][0]
    for bad in (b"", b"text", cut[:-2], cut[:40], own[:-30] + b"\xff\xd9", own + b"x", cut[:2] + cut[2:].replace(b"\xff\xc4", b"\xff\xe4", 1)):
        cases.append((bad, None))
    cases.append((own + own, b"own payload ".ljust(192) * 2))
    order = rng.permutation(len(cases)).tolist()
    got = jpeg.read_media([cases[i][0] for i in order])
    for i, found in zip(order, got):
        assert (found and found[0]) == cases[i][1], i


def test_features_of_null_and_broken_media(spark):
    good = jpeg.encode_payloads(b"q" * 192, [192])[0]
    rows = [(1, 192, good), (2, 0, None), (3, 4, b"text"), (4, 0, b""), (None, 0, None), (6, 1, good[:-9])]
    got = {r["doc_id"]: r.asDict() for r in jpeg.features(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1]["payload_bytes"] == 192 and got[1]["feature"].startswith("192x1:")
    assert got[2]["media_bytes"] is got[None]["media_sha256"] is got[3]["feature"] is got[6]["payload_sha256"] is None
    assert (got[3]["media_bytes"], got[4]["media_bytes"]) == (4, 0)
    only = jpeg.features(spark.createDataFrame([(1, 0, None)] * 3, "doc_id long, n_bytes long, media binary")).collect()
    assert len(only) == 3 and all(r["feature"] is None for r in only)


def test_media_of_the_whole_table(spark, table):
    """op8's query on the table against the contract, text by text."""
    got = {r["doc_id"]: r for r in op8_jpeg_media(spark, "/root/testdata/sf0.001").collect()}
    rows = table.collect()
    assert len(got) == len(rows)
    for r in rows:
        raw = (r["text"] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        mine = got[r["doc_id"]]
        assert (mine["n_bytes"], mine["payload_bytes"], mine["payload_sha256"], mine["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert mine["width"] == 1536 and mine["height"] == len(payload) // 192 * 8


# op 9


@settings(max_examples=60, deadline=None)
@given(sizes=st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_windows_hold_everything_once(sizes):
    out = packing.windows(sizes, 100)
    assert sorted(i for w in out for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 100 for w in out)


def test_differencing_is_near_equal():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 500, 400).tolist()
    sums = [sum(sizes[i] for i in w) for w in packing.difference(sizes, 20)]
    assert max(sums) - min(sums) <= 3
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.difference([8, 7, 6, 5, 4], 2)) == [14, 16]


def test_packing(spark, odd, table, none, library):
    for docs in (table, odd):
        want = Counter(str((r["doc_id"], len(ids_of(library, r["text"])))) for r in docs.collect())
        texts = defaultdict(list)
        for r in docs.collect():
            texts[r["doc_id"]].append(ids_of(library, r["text"]))
        rows = packing.pack(docs, tokenizer(WORDS)).collect()
        windows, by_doc = defaultdict(list), defaultdict(list)
        for r in rows:
            windows[r["sequence_id"]].append(r)
            by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        used = padded = 0
        for w in windows.values():
            at = 0
            for r in sorted(w, key=lambda r: r["offset"]):
                assert r["offset"] == at and r["length"] > 0
                at += r["length"]
            assert at <= 4096
            used, padded = used + at, padded + (at if at & (at - 1) == 0 else 4096)
        assert padded <= 1.02 * used
        for (doc, n), mine in by_doc.items():
            times = want[str((doc, n))]
            assert sum(r["length"] for r in mine) == n * times
            for r in mine:
                assert any(len(x) == n and crc(x[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for x in texts[doc])
            covered = Counter(i for r in mine for i in range(r["start"], r["start"] + r["length"]))
            assert set(covered.values()) == {times}
        assert set(want) == {str(k) for k in by_doc}
    assert packing.pack(none, tokenizer(WORDS)).count() == 0


# op 10


def word_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))) if words else frozenset()


def brute_components(rows, k, num, den):
    sets = [word_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by[g].append(i)
    for i, s in enumerate(sets):
        for j, both in Counter(j for g in s for j in by[g] if j < i).items():
            if den * both >= num * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return sorted(str((d, len(sets[i]), least[find(i)] if sets[i] else d)) for i, (d, _) in enumerate(rows))


def families(seed, n=12):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    rows, shared = [], [word() for _ in range(50)]
    for f in range(n):
        base = [word() for _ in range(int(rng.integers(5, 90)))] + (shared if f % 3 == 0 else [])
        for _ in range(int(rng.integers(1, 9))):
            copy = list(base)
            for _ in range(int(rng.integers(0, max(2, len(base) // 12)))):
                copy[int(rng.integers(len(copy)))] = word()
            rows.append((len(rows) * 3, " ".join(copy).upper() if rng.random() < 0.2 else " \n".join(copy)))
    return rows


@pytest.mark.parametrize("k, num, den", [(3, 85, 100), (5, 4, 5)])
def test_components_against_all_pairs(spark, table, k, num, den):
    rows = families(k) + [(10_000 + r["doc_id"], r["text"]) for r in table.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.components(docs, k=k, numerator=num, denominator=den).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == brute_components(rows, k, num, den)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_components_of_odd_rows(spark, odd, none):
    got = neardup.components(odd).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == brute_components([(r[0], r[1]) for r in ROWS], 5, 4, 5)
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in ROWS if r[0] != 8)
    assert neardup.components(none).count() == 0 == neardup.keep_one(none).count()


def test_one_row_of_each_component_stays(spark):
    text = lambda c, n=40: " ".join(f"{c}{i}" for i in range(n))
    rows = [
        (1, text("a")), (2, text("a", 41)), (2, text("b")),  # 2 repeats, and one of its texts is a near copy of 1
        (3, text("c")), (3, text("c", 41)), (3, text("c").upper()),  # near copies share an identifier
        (None, text("d")), (None, text("d")), (None, text("d", 41)),  # no identifier in the whole component
        (None, text("a")), (None, text("e")), (None, " "), (None, " "), (None, None), (5, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], word_set(r["text"], 5) and r["text"].lower()[0]) for r in neardup.keep_one(docs).collect())
    assert got == {(1, "a"): 1, (2, "b"): 1, (3, "c"): 1, (None, "d"): 1, (None, "e"): 1, (None, frozenset()): 3, (5, frozenset()): 2}


def test_a_node_meets_its_own_text_only(spark, monkeypatch):
    rows = [(i % 2 or None, " ".join(f"w{i // 2}x{j}" for j in range(30 + i % 2 * 2))) for i in range(40)]
    docs, met, plain = spark.createDataFrame(rows, "doc_id long, text string"), [], neardup.common.arrow_map

    def counted(df, run, schema):
        if schema == "node long, shingles binary":
            met.append(df.count())
        return plain(df, run, schema)

    monkeypatch.setattr(neardup.common, "arrow_map", counted)
    got = neardup.components(docs).collect()
    assert met == [40]
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == brute_components(rows, 5, 4, 5)


def test_a_chain_has_one_root(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in neardup.connected(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_the_posterior_s_bounds():
    bands, rows = neardup.bands_for(0.85)
    assert (1 - 0.85**rows) ** bands < 1e-6 and bands * rows <= 128
    rng = np.random.default_rng(1)
    for n, least in neardup.least_matches(0.85, 1e-6):
        assert 0 < least < 0.85 * n and (rng.binomial(n, 0.85, 20_000) < least).mean() < 1e-3


# op 5


def test_a_weight_does_not_depend_on_its_block():
    rng = np.random.default_rng(5)
    ratio = resample.Ratio(rng.integers(0, 99, resample.BUCKETS), rng.integers(1, 999, resample.BUCKETS), 0.5)
    texts = [None, "", *(" ".join(rng.choice(["ab", "A9", "x-y", "$$", "Cd.", "e_f!"], n)) for n in rng.integers(1, 300, 200)), ""]
    block = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    whole = resample._weights(block, 0, ratio, {})
    assert whole.tolist() == [resample._weights(block.slice(i, 1), 0, ratio, {})[0] for i in range(len(texts))]


# op 6


@settings(max_examples=300, deadline=None)
@given(scores=st.lists(st.sampled_from([-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0, 4.0]), max_size=25))
def test_segments_are_the_maximal_ones(scores):
    def split(a, b):
        """By the definition: the best segment, then the same to its left and right."""
        best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i, j = -best[2], -best[2] - best[1]
        return split(a, i) + [best[0]] + split(j, b)

    got = toxicity.maximal_segments(scores)
    assert sorted(s for *_, s in got) == pytest.approx(sorted(split(0, len(scores))))
    assert all(s == pytest.approx(sum(scores[a:b])) for a, b, s in got)
