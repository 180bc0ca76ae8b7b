"""Operators with exact results: sharding, media, mixing, packing, exact dedup, rollups."""

import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from corpus_rows import table_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectide.llm import exact_dedup, media, mixing, packing, rollups, sharding
from vectide.llm.common import BROADCAST_ROWS


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(df):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in df.select("doc_id", "text", "source").collect()]


# sharding


def brute_shards(rows, limit):
    """rows (bits, bytes): split a bucket on its next bit while it is too large and has two rows."""
    out, todo = {}, [("", rows)]
    while todo:
        prefix, own = todo.pop()
        if sum(b for _, b in own) <= limit or len(own) == 1:
            out[prefix] = own
            continue
        for bit in "01":
            part = [r for r in own if r[0][len(prefix)] == bit]
            if part:
                todo.append((prefix + bit, part))
    return out


def test_shards_like_splitting_one_by_one(spark):
    rng = random.Random(1)
    rows = [(k, "x" * rng.choice([10, 100, 1000, 9000]), None, None) for k in range(300)]
    got = sharding.shard(table_of(spark, rows), limit=5000).collect()
    bits = {k: f"{int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16):060b}" for k, *_ in rows}
    want = brute_shards([(bits[k] + "0" * 60, len(t)) for k, t, *_ in rows], 5000)
    assert Counter(r["shard"] for r in got) == Counter({p: len(own) for p, own in want.items()})
    for r in got:
        assert bits[r["doc_id"]].startswith(r["shard"]) and r["shard_bytes"] == sum(b for _, b in want[r["shard"]]) and r["shard_docs"] == len(want[r["shard"]])


def test_shards_of_odd_rows(odd, none):
    got = sharding.shard(odd, limit=2000).collect()
    assert len(got) == odd.count() and all(r["shard_bytes"] <= 2000 or r["shard_docs"] == 1 for r in got)
    sums = defaultdict(int)
    for r in got:
        sums[r["shard"]] += r["n_bytes"]
    assert all(sums[r["shard"]] == r["shard_bytes"] for r in got)
    assert sharding.shard(none).count() == 0


def test_one_key_is_split_by_rows(spark):
    got = sharding.shard(table_of(spark, [(7, "y" * 100, None, None)] * 200), limit=1000).collect()
    assert len(got) == 200 and all(r["shard_bytes"] <= 1000 for r in got)


def test_written_shards(spark, odd, tmp_path):
    sharding.write_shards(odd.drop("row"), str(tmp_path / "s"), limit=2000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == odd.count()


# media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000) | st.just(b"\xff\xfb\x90\x00" * 900))
def test_media_round_trip(data):
    padded = data + bytes(-len(data) % 64 if data else 64)
    stream = media.encode_mpeg(padded, len(data))
    s = media.parse_mpeg(stream)
    assert media.payload_of(stream, s) == (padded, len(data))
    assert s.crc_bad == 0 and s.skipped == 0 and s.crc_good == len(s.offsets) + 1
    assert s.table_frames == len(s.offsets) and s.table_bytes == len(stream) - s.offsets[0] + (s.offsets[0] - stream.index(b"\xff\xfa"))
    assert s.samples == 1152 * len(s.offsets) and s.rate == 32000
    assert all(media.header(stream[o : o + 4]) for o in s.offsets)


def test_media_finds_frames_after_damage():
    clean = media.encode_mpeg(bytes(range(256)) * 40)
    s = media.parse_mpeg(clean)
    third = s.offsets[2]
    hurt = clean[:third] + b"\x00" * 7 + b"\xff\xfb" + clean[third:] + b"TAG" + bytes(125)
    t = media.parse_mpeg(hurt)
    assert len(t.offsets) == len(s.offsets) and t.skipped == 9 and "ID3v1" in t.tags
    flipped = bytearray(clean)
    flipped[third + 8] ^= 1
    assert media.parse_mpeg(bytes(flipped)).crc_bad == 1


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 2200), st.lists(st.tuples(st.sampled_from([b"TAG", b"ID3\x04\0\0\0\0\0\x05", b"Xing", b"Info", b"VBRI", b"\xff\xfa\x90\xc0", b"\xff\xfb\x90\x00"]), st.integers(0, 400)), max_size=4))
def test_media_round_trip_with_marks_near_the_end(size, marks):
    data = bytearray(b"x" * size)
    for mark, back in marks:
        at = max(0, size - back)
        data[at : at + len(mark)] = mark
    check_round_trip(bytes(data))


@pytest.mark.parametrize("mark", [b"TAG", b"ID3", b"\xff\xfa"])
@pytest.mark.parametrize("size", [100, 300, 2000])
def test_media_round_trip_with_a_mark_at_each_offset(mark, size):
    for at in range(max(0, size - 200), size):
        check_round_trip(b"y" * at + mark + b"y" * max(0, size - at - len(mark)))


def check_round_trip(data):
    stream = media.stored_form(data)
    s = media.parse_mpeg(stream)
    assert media.payload_of(stream, s) == (data + bytes(-len(data) % 64 if data else 64), len(data))
    assert s.tags == ["ID3v2.4"] and s.skipped == 0 and s.crc_bad == 0


def frame_of(four, body, wrong=0):
    """A frame with a checksum over its header and so many bits of its body, by long division."""
    h = media.header(four)
    bits = media.protected_bits(h, body)
    message = int.from_bytes(four[2:4], "big") << bits | int.from_bytes(body, "big") >> (8 * len(body) - bits)
    n = 16 + bits
    rest = message << 16 ^ 0xFFFF << n
    for k in range(n + 15, 15, -1):
        if rest >> k & 1:
            rest ^= 0x18005 << (k - 16)
    return (four + (rest ^ wrong).to_bytes(2, "big") + body).ljust(h.length, b"\0")


@pytest.mark.parametrize("four, bits", [
    (b"\xff\xfe\x90\x00", 256),  # Layer I, two channels of 32 allocations of 4 bits
    (b"\xff\xfe\x90\xc0", 128),  # Layer I, mono
    (b"\xff\xfe\x90\x50", 4 * (8 * 2 + 24)),  # Layer I, channels joint from subband 8
    (b"\xff\xfc\xa0\xc0", None),  # Layer II, mono, 160 kbit/s: 30 subbands, and 2 bits for each that has samples
])
def test_media_checksums_of_layers_i_and_ii(four, bits):
    body = b"\x55" * 40
    h = media.header(four)
    if h.layer == 2:
        sizes = [4] * 11 + [3] * 12 + [2] * 7
        stream, at, used = "".join(f"{x:08b}" for x in body), 0, 0
        for n in sizes:
            used += "1" in stream[at : at + n]
            at += n
        bits = at + 2 * used
    assert media.protected_bits(h, body) == bits
    good, bad = frame_of(four, body), frame_of(four, body, 1)
    s = media.parse_mpeg(good * 3 + bad + good)
    assert (len(s.offsets), s.crc_good, s.crc_bad) == (5, 4, 1)


def test_media_without_frames():
    empty = media.parse_mpeg(b"")
    assert "kbps=none" in media.feature_of(empty)
    with pytest.raises(ValueError):
        media.payload_of(b"", empty)
    whole = media.stored_form(b"z" * 5000)
    with pytest.raises(ValueError):
        media.payload_of(whole[:-900], media.parse_mpeg(whole[:-900]))


def test_media_headers_and_tables():
    assert media.header(b"\xff\xfb\x90\x00").length == 417 and media.header(b"\xff\xfb\x92\x00").length == 418
    assert media.header(b"\xff\xf3\x80\xc0").samples == 576 and media.header(b"\xff\xff\x10\x00").samples == 384
    assert not any(media.header(x) for x in (b"\xff\xeb\x90\x00", b"\xff\xf9\x90\x00", b"\xff\xfb\xf0\x00", b"\xff\xfb\x00\x00", b"\xff\xfb\x9c\x00", b"\xff"))
    frame = b"\xff\xfb\x90\x00" + bytes(413)
    vbri = bytearray(frame)
    vbri[36:62] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 4170, 9, 2, 1, 2, 1)
    s = media.parse_mpeg(bytes(vbri) + frame * 9)
    assert (s.table, s.table_frames, s.table_bytes, len(s.offsets)) == ("VBRI", 9, 4170, 9)
    assert s.seek(0) == 417 and s.seek(1152 / 44100 * 3) == 4 * 417 and s.seek(1e9) == s.offsets[-1]
    assert media.parse_mpeg(b"").offsets == [] and media.parse_mpeg(b"no sound").skipped == 8


def test_crc_by_division():
    """The remainder of the message by the polynomial, bit by bit over one long number."""
    data = b"\x90\x00" + bytes(range(32))
    bits = int.from_bytes(data, "big") << 16 ^ 0xFFFF << (8 * len(data))
    for k in range(8 * len(data) + 15, 15, -1):
        if bits >> k & 1:
            bits ^= 0x18005 << (k - 16)
    assert media.crc16(data) == bits


def test_media_facts(odd, none):
    got = [r.asDict() for r in media.media_facts(odd).collect()]
    assert len(got) == odd.count()
    want = Counter()
    for _, t, _ in texts(odd):
        b = t.encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        stream = media.encode_mpeg(p, len(b))
        frames = []
        at = stream.index(b"\xff\xfa")
        while at < len(stream):
            frames.append(at)
            at += media.header(stream[at : at + 4]).length
        kbps = [media.header(stream[o : o + 4]).kbps for o in frames[1:]]
        n = len(kbps)
        feature = f"{1152 * n}/32000s;frames={n};table=Xing:{n};kbps={min(kbps)}-{max(kbps)};crc={n + 1}/{n + 1};tags=ID3v2.4;skipped=0"
        digests = (len(stream), hashlib.sha256(stream).hexdigest(), feature, tuple(frames[1:]))
        want[len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), *digests] += 1
    fields = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    assert Counter((*(r[f] for f in fields), tuple(r["offsets"])) for r in got) == want
    assert media.media_facts(none).count() == 0


# mixing


def brute_mix(rows):
    size = [len(WORD.findall(t)) for _, t, _ in rows]
    total = defaultdict(int)
    for (_, _, s), n in zip(rows, size, strict=True):
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, open_ = 1.5 * sum(size), set(names)
    while open_ and left > 1e-9:
        w = sum(weight[s] for s in open_)
        give = {s: left * weight[s] / w for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += give[s]
            if target[s] >= 2 * total[s]:
                left += target[s] - 2 * total[s]
                target[s] = 2.0 * total[s]
                open_.discard(s)
    return size, total, target


def test_mix_against_resharing(odd, none):
    rows = texts(odd)
    size, total, target = brute_mix(rows)
    got = mixing.mix(odd, carry=True).collect()
    assert len(got) == len(rows)
    taken, most = defaultdict(int), defaultdict(int)
    for r in got:
        s = r["row"]["source"]
        assert r["source_size"] == total[s] and r["target"] == pytest.approx(target[s]) and r["taken"] <= 2 * r["size"] and r["taken"] == r["times"] * r["size"]
        taken[s] += r["taken"]
        most[s] = max(most[s], r["size"])
    for s in total:
        assert abs(taken[s] - target[s]) <= most[s]
    assert sorted(map(repr, mixing.mix(odd).collect())) == sorted(map(repr, mixing.mix(odd).collect()))
    assert mixing.mix(none).count() == 0


def test_mix_threshold_is_the_nearest_prefix_by_hash(spark):
    rng = random.Random(3)
    rows = [(k, "w " * rng.randrange(0, 50), None, rng.choice("abcd")) for k in range(400)]
    got = mixing.mix(table_of(spark, rows)).collect()
    h = {k: int(hashlib.md5(str(k).encode()).hexdigest()[:13], 16) for k, *_ in rows}
    for s in "abcd":
        own = sorted((r for r in got if rows[r["doc_id"]][3] == s), key=lambda r: h[r["doc_id"]])
        whole = int(own[0]["target"] // own[0]["source_size"])
        rest, at = own[0]["target"] - whole * own[0]["source_size"], 0
        for r in own:
            more = 2 * at + r["size"] <= 2 * rest
            assert r["taken"] == r["size"] * (whole + more) or r["size"] == 0
            at += r["size"]


def test_mixes_are_nested(spark):
    rng = random.Random(4)
    rows = table_of(spark, [(k, "w " * rng.randrange(1, 50), None, "a" if k % 3 else "b") for k in range(200)])
    small = {r["doc_id"]: r["taken"] for r in mixing.mix(rows, share=0.6).collect()}
    large = {r["doc_id"]: r["taken"] for r in mixing.mix(rows, share=0.9).collect()}
    assert all(small[k] <= large[k] for k in small) and sum(small.values()) < sum(large.values())


def test_mix_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr("vectide.llm.common.BROADCAST_ROWS", 1)
    rows = [(k, "w " * (k % 7 + 1), None, f"s{k % 5}") for k in range(100)]
    salted = sorted(map(tuple, mixing.mix(table_of(spark, rows)).collect()))
    monkeypatch.setattr("vectide.llm.common.BROADCAST_ROWS", BROADCAST_ROWS)
    assert salted == sorted(map(tuple, mixing.mix(table_of(spark, rows)).collect()))


# packing


def padded(lengths, counts, bounds):
    return sum(c * min(b for b in bounds if b >= n) for n, c in zip(lengths, counts, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 5))
def test_buckets_are_optimal(histogram, k):
    lengths, counts = list(histogram), list(histogram.values())
    got = packing.bucket_lengths(lengths, counts, k)
    top = max(lengths)
    best = min(padded(lengths, counts, (*c, top)) for n in range(min(k, len(lengths))) for c in itertools.combinations(sorted(set(lengths) - {top}), n))
    assert len(got) <= k and got[-1] == top and padded(lengths, counts, got) == best


def test_batches(odd, none):
    got = packing.pack(odd, max_len=1000, buckets=4, budget=3000).collect()
    want = Counter()
    for i, t, _ in texts(odd):
        n = len(WORD.findall(t))
        for p in range(max(1, math.ceil(n / 1000))):
            want[i, p, min(1000, n - 1000 * p)] += 1
    assert Counter((r["doc_id"], r["part"], r["length"]) for r in got) == want
    batches = defaultdict(list)
    for r in got:
        assert r["length"] <= r["bucket_len"] and (r["batch"] is None) == (r["length"] == 0)
        if r["batch"] is not None:
            batches[r["bucket_len"], r["batch"]].append(r["slot"])
    for (b, k), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= max(1, 3000 // b)
        assert len(slots) == max(1, 3000 // b) or (b, k + 1) not in batches
    assert packing.pack(none).count() == 0 and packing.bucket_lengths([], []) == []


def test_batches_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "PER_SHARD", 10)
    rows = [(k, "w " * (k % 40 + 1), None, None) for k in range(300)]
    got = packing.pack(table_of(spark, rows), buckets=3, budget=200).collect()
    full = Counter((r["bucket_len"], r["batch"]) for r in got)
    for b in {r["bucket_len"] for r in got}:
        sizes = [n for (x, _), n in sorted(full.items()) if x == b]
        assert sizes[:-1] == [200 // b] * (len(sizes) - 1)


# exact dedup


def brute_copies(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i is None, i))
    return groups


@pytest.mark.parametrize("first, second", [(64, 4096), (2, 3)])
def test_copies_against_brute_force(odd, none, first, second):
    groups = brute_copies(texts(odd))
    got = exact_dedup.exact_dedup(odd, first=first, second=second).collect()
    want = Counter()
    for norm, own in groups.items():
        keep = min(own, key=lambda x: (x[0], x[1], x[2] or 0))[2]
        for _, _, i in own:
            want[i, keep, len(own), hashlib.sha256(norm.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_copies_with_broadcast_groups(odd, monkeypatch):
    """Groups of more than HOT rows stay where they are and give the same rows."""
    want = sorted(map(repr, exact_dedup.exact_dedup(odd, first=2, second=3).collect()))
    monkeypatch.setattr("vectide.llm.common.HOT", 2)
    assert sorted(map(repr, exact_dedup.exact_dedup(odd, first=2, second=3).collect())) == want


def test_bitmap_has_all_keys_and_few_others(spark):
    from vectide.llm.common import bitmap, in_bitmap

    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    parts, bits = bitmap(keys)
    got = in_bitmap(spark.range(60_000).withColumn("_part", F.lit(1)), parts, bits, F.xxhash64("id"), "maybe")
    assert got.columns == ["id", "_part", "maybe"]
    hits = {r["id"] for r in got.where("maybe").collect()}
    assert hits >= set(range(3000)) and len(hits) < 3000 + 57_000 // 8
    parts, bits = bitmap(keys.limit(0))
    assert in_bitmap(spark.range(9), parts, bits, F.xxhash64("id"), "maybe").where("maybe").count() == 0


def test_copies_carry_their_rows(odd):
    kept = exact_dedup.exact_dedup(odd, carry=True).where("kept").select("row.*")
    assert kept.columns == odd.columns and kept.count() == len(brute_copies(texts(odd)))


def test_long_common_beginnings(spark):
    base = "ab" * 5000
    rows = [(1, base + "x", None, None), (2, base + "y", None, None), (3, base, None, None), (4, base + " x", None, None), (5, base[:-1], None, None)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(table_of(spark, rows)).collect()}
    assert got == {1: (4, 2), 2: (2, 1), 3: (3, 1), 4: (4, 2), 5: (5, 1)}


# rollups


def changes(spark, rows):
    return rollups.signed(spark.createDataFrame(rows, "source string, lang string, tokenizer string, op string, tokens long, old_tokens long"))


def totals(store):
    return {tuple(r)[:3]: tuple(r)[3:] for r in store.totals().collect()}


def test_rollups(spark, tmp_path):
    store = rollups.Rollups(spark, str(tmp_path / "r"))
    assert store.totals().collect() == [] and store.totals().columns == ["source", "lang", "tokenizer", "docs", "tokens"]
    first = changes(spark, [("a", "x", "t", "insert", 5, None), ("a", "x", "t", "insert", 7, None), (None, None, "t", "insert", None, None)])
    assert store.commit("1", first) and not store.commit("1", first)
    assert store.commit("2", changes(spark, [("a", "x", "t", "revise", 9, 5), ("a", "x", "t", "delete", None, 7)]))
    want = {("a", "x", "t"): (1, 9), (None, None, "t"): (1, 0)}
    assert totals(store) == want
    store.compact()
    assert totals(store) == want and not store.commit("1", first)
    assert store.commit("3", changes(spark, [("a", "x", "t", "delete", None, 9)]))
    store.compact()
    assert totals(store) == {("a", "x", "t"): (0, 0), (None, None, "t"): (1, 0)}
    assert store.commit("4", changes(spark, [])) and totals(store)["a", "x", "t"] == (0, 0)


@pytest.mark.parametrize("op", ["upsert", None])
def test_unknown_changes_are_rejected(spark, op):
    with pytest.raises(Exception, match="unknown op"):
        changes(spark, [("a", "x", "t", op, 5, None)]).collect()


def test_counts_by_public_vocabularies(odd, none):
    files = {"byte_bpe": "/opt/tokenizers/byte_bpe_50k.json", "piece_bpe": "/opt/tokenizers/piece_bpe_32k.model"}
    got = rollups.vocabulary_counts(odd, files).collect()
    count = [rollups.counter(path) for path in files.values()]
    want = Counter((i, s, *(c([t])[0] for c in count)) for i, t, s in texts(odd))
    assert Counter((r["doc_id"], r["source"], r["byte_bpe"], r["piece_bpe"]) for r in got) == want
    assert {r["byte_bpe"] for r in got if r["doc_id"] in (100, 101)} == {0} and count[0](["a <|endoftext|>"])[0] > 3
    assert rollups.vocabulary_counts(none, files).count() == 0


def test_a_batch_cut_off_does_not_count(spark, tmp_path):
    store = rollups.Rollups(spark, str(tmp_path / "r"))
    rows = changes(spark, [("a", "x", "t", "insert", 5, None)])
    store.commit("1", rows)
    store.commit("2", rows)
    (tmp_path / "r" / "batch-2" / "_SUCCESS").unlink()
    assert totals(store) == {("a", "x", "t"): (1, 5)}
    assert store.commit("2", rows) and totals(store) == {("a", "x", "t"): (2, 10)}


def test_document_counts(odd, none):
    got = rollups.document_counts(odd).collect()
    assert sorted(r["words"] for r in got) == sorted(len(WORD.findall(t)) for _, t, _ in texts(odd))
    assert all(r["solid"] <= r["words"] <= r["pieces"] for r in got) and rollups.document_counts(none).count() == 0
