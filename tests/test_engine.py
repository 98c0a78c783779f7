"""Operators against small literal cases and a dictionary model."""

import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.functions import codec, filters, keys
from tidelog.operators import batch, cursor, resolve
from tidelog.operators.batch import WriteBatch
from tidelog.plans import storage
from tidelog.plans.engine import Database
from tidelog.schema import LOG, Options, StoreError
from tidelog.sources import wal
from tidelog.streaming import ingest

CITY = [(b"city", 1, 1, b"shanghai"), (b"city", 2, 1, b"shenzhen"), (b"city", 3, 0, None)]


def rows(df):
    return sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect())


def test_snapshots_of_one_key(spark):
    log = spark.createDataFrame(CITY, LOG)
    probes = spark.createDataFrame([(b"city", s) for s in range(5)], "k binary, snap bigint")
    got = {r.snap: (r.outcome, r.v and bytes(r.v)) for r in resolve.multi_get(log, probes, 2).collect()}
    assert got == {0: ("ABSENT", None), 1: ("OK", b"shanghai"), 2: ("OK", b"shenzhen"), 3: ("DELETED", None), 4: ("DELETED", None)}
    assert [bytes(r.v) for r in resolve.get(log, bytearray(b"city"), 2).collect()] == [b"shenzhen"]
    assert resolve.get(log, bytearray(b"city")).count() == 0


def test_put_beats_delete_at_equal_sequence(spark):
    log = spark.createDataFrame([(b"a", 5, 0, None), (b"a", 5, 1, b"x")], LOG)
    assert rows(resolve.live(log)) == [(b"a", 5, b"x")]


def test_cursor(spark):
    kv = [(c.encode(), i + 1, 1, (c * 3).encode()) for i, c in enumerate("fgabcdejklmnhi")]
    log = spark.createDataFrame(kv, LOG).repartition(3)
    c = cursor.Cursor(log)
    assert c.seek_to_first().key() == b"a" and c.next().key() == b"b" and c.prev().key() == b"a"
    assert not c.prev().valid
    assert c.seek_to_last().key() == b"n" and not c.next().valid
    assert c.seek(bytearray(b"0")).value() == b"aaa" and not c.seek(bytearray(b"x")).valid
    targets = spark.createDataFrame([(x,) for x in (b"0", b"a", b"n", b"x")], "t binary")
    for how, want in {"ge": "aan-", "gt": "ab--", "le": "-ann", "lt": "--mn"}.items():
        found = {bytes(r.t): r.found for r in cursor.neighbours(log, targets, how).collect()}
        assert "".join("-" if found[t] is None else bytes(found[t]).decode() for t in (b"0", b"a", b"n", b"x")) == want, how
    assert not cursor.Cursor(log.limit(0)).seek_to_first().valid
    assert [r.k.decode() for r in resolve.ordered(log, True).collect()] == list("nmlkjihgfedcba")


def test_ranges_and_ordinals_of_byte_keys(spark):
    rng = random.Random(8)
    kv = [(f"shared-prefix-{rng.randrange(10**6):06d}".encode()[: rng.randint(15, 20)], i, 1, b"") for i in range(1, 400)]
    log = spark.createDataFrame([*kv, (None, 400, 1, b"")], LOG).repartition(5)
    assert cursor.ranged(log, log, "k").select("_b").distinct().count() > 2
    want = [(k, s) for k, s, _, _ in sorted(kv, key=lambda r: (r[0], -r[1]))] + [(None, 400)]
    for reverse in (False, True):
        got = [(r.k and bytes(r.k), r.seq) for r in cursor.ordinal(log, reverse).orderBy("ordinal").collect()]
        assert got == (want[::-1] if reverse else want)
    ks = sorted({k for k, *_ in kv})
    nxt = {bytes(r.k): r.next_k and bytes(r.next_k) for r in cursor.with_next(log.where("k IS NOT NULL")).collect()}
    assert nxt == dict(zip(ks, [*ks[1:], None]))


def test_batches(spark):
    ops = [(1, b"city", b"shanghai2"), (1, b"city", b"shenzhen2"), (0, b"city", None)]
    df = spark.createDataFrame([(4, ops, 3), (7, [], 1)], "base_seq bigint, ops array<struct<op: int, k: binary, v: binary>>, n int")
    assert [(r.seq, r.op) for r in batch.expand(df).orderBy("seq").collect()] == [(4, 1), (5, 1), (6, 0)]
    assert [r.s for r in df.select(batch.check("ops", "n").alias("s")).collect()] == ["OK", "Corruption"]


def test_group_commit(spark):
    w = spark.createDataFrame(
        [(0, i, n, s) for i, (n, s) in enumerate([(100, False), (50, False), (131100, False), (10, True), (10, False), (900000, False), (200000, False)])],
        "q int, t int, n bigint, s boolean",
    )
    got = [r.commit_group for r in batch.group_commit(w, "q", "t", "n", "s").orderBy("t").collect()]
    assert got == [0, 0, 1, 2, 2, 3, 4]


def test_separators(spark):
    one = lambda f, *x: bytes(spark.createDataFrame([tuple(x)], ", ".join(f"c{i} binary" for i in range(len(x)))).select(f(*[F.col(f"c{i}") for i in range(len(x))])).first()[0])
    assert one(keys.separator, b"shandong", b"shanghai") == b"shane"
    assert one(keys.separator, b"shang", b"shanghai") == b"shang"
    assert one(keys.separator, b"shanghai", b"shenzhen") == b"shb"
    assert one(keys.successor, b"shanghai") == b"t"
    assert one(keys.successor, b"\xff") == b"\xff"
    assert one(keys.successor, b"\xffb") == b"\xffc"
    assert one(keys.successor, b"") == b""


def test_filter_bytes_and_rate():
    assert filters.build([filters.fnv1_bytes(x) for x in (b"hello", b"world")]).hex() == "100804499280402006"
    big = filters.build([filters.fnv1_bytes(struct.pack("<I", i)) for i in range(10_000)])
    assert len(big) == 12_501
    assert all(filters.matches(struct.pack("<I", i), big) for i in range(0, 10_000, 7))
    assert sum(filters.matches(struct.pack("<I", i + 10_000_000), big) for i in range(10_000)) == 77
    assert not filters.matches(b"x", b"") and filters.encode_block({}) == b"\0\0\0\0\x0b"


def test_filter_block(spark):
    chunks = spark.createDataFrame([(0, b"foo"), (2000, b"bar"), (3100, b"box"), (9000, b"box"), (9000, b"hello")], "block_offset bigint, k binary")
    block = filters.filter_block(chunks)
    asked = spark.createDataFrame([(o, k) for o in (0, 2000, 3100, 4100, 6100, 9000) for k in (b"foo", b"bar", b"box", b"hello")], "block_offset bigint, k binary")
    hits = {o: set() for o in (0, 2000, 3100, 4100, 6100, 9000)}
    for r in filters.probe_block(asked, block).where("may_match").collect():
        hits[r.block_offset].add(bytes(r.k))
    assert hits == {0: {b"foo", b"bar"}, 2000: {b"foo", b"bar"}, 3100: {b"box"}, 4100: set(), 6100: set(), 9000: {b"box", b"hello"}}


def test_wal_framing():
    records = [b"a" + bytes(998) + b"a", b"b" + bytes(97268) + b"b", b"c" + bytes(7998) + b"c", b"x" * 27, b"", b"y" * 18]
    data = wal.frame(records)
    assert wal.unframe(data) == ([r for r in records if r], "OK")
    assert wal.unframe(data[:-3])[0] == records[:4] and wal.unframe(data[:-3])[1] == "OK"
    broken = bytearray(data)
    broken[1100] ^= 1
    assert wal.unframe(bytes(broken)) == (records[:1], "Corruption")
    assert [(k, len(p)) for _, k, p in wal.fragments(records[1], 1007)] == [(2, 31754), (3, 32761), (4, 32755)]


def test_wal_source(spark, tmp_path):
    (tmp_path / "000003.log").write_bytes(wal.frame([wal.encode_batch(1, WriteBatch().put(b"a", b"1").delete(b"b")), wal.encode_batch(3, WriteBatch().put(b"", b""))]))
    (tmp_path / "000004.log").write_bytes(b"\1" * 40)
    got = wal.read_logs(spark, f"{tmp_path}/*.log").orderBy("path", "seq").collect()
    assert [(r.status, r.k and bytes(r.k), r.seq, r.op) for r in got[:3]] == [("OK", b"a", 1, 1), ("OK", b"b", 2, 0), ("OK", bytearray(), 3, 1)]
    assert len(got) == 3 or got[3].status == "Corruption"


def test_codec(spark):
    assert codec.crc32c_bytes(b"123456789") == 0xE3069283
    df = spark.createDataFrame([(b"123456789", 1 << 40), (b"", 0)], "x binary, n bigint")
    got = df.select(codec.crc32c(F.col("x")), codec.varint(F.col("n")), codec.fixed64(F.col("n")), codec.unmask_crc(codec.mask_crc(F.col("n") % 1000)), codec.length_prefixed(F.col("x"))).collect()
    assert got[0][0] == 0xE3069283 and got[1][0] == 0
    assert bytes(got[0][1]) == codec.put_varint(1 << 40) and struct.unpack("<q", bytes(got[0][2]))[0] == 1 << 40
    assert got[0][3] == (1 << 40) % 1000 and bytes(got[0][4]) == b"\x09123456789"
    for n in (0, 127, 128, 1 << 35, (1 << 63) - 1):
        assert codec.get_varint(codec.put_varint(n)) == (n, len(codec.put_varint(n)))
    with pytest.raises(StoreError):
        codec.get_slice(b"\x05abc")


def test_sorted_table(spark, tmp_path):
    log = spark.createDataFrame([(f"{i % 50:04d}".encode(), i, 1, b"v") for i in range(1, 500)], LOG)
    meta = storage.write_sorted(log, f"{tmp_path}/t", 4, distinct_keys=50)
    files = sorted(meta.collect(), key=lambda r: bytes(r.smallest.k))
    assert sum(r.n for r in files) == 499 and all(bytes(a.largest.k) < bytes(b.smallest.k) for a, b in zip(files, files[1:]))
    one = storage.read_pruned(spark, meta, bytearray(b"0007"), log.schema)
    assert one.count() == 10 and len(one.inputFiles()) == 1


def test_database_matches_model(spark, tmp_path):
    rng, model, history = random.Random(3), {}, {}
    opts = Options(write_buffer_bytes=1 << 20)
    db = Database(spark, str(tmp_path / "db"), opts)
    with pytest.raises(StoreError):
        Database(spark, str(tmp_path / "db"), opts)
    for step in range(60):
        b = WriteBatch()
        for _ in range(rng.randint(1, 4)):
            k = bytes([97 + rng.randint(0, 7)]) * rng.randint(0, 2)
            if rng.random() < 0.3:
                b.delete(k)
                model.pop(k, None)
            else:
                v = str(rng.random()).encode()
                b.put(k, v)
                model[k] = v
        history[db.write(b, sync=False)] = dict(model)
        if step == 20:
            db.flush()
        if step == 40:
            db.close()
            db = Database(spark, str(tmp_path / "db"), opts)
    for seq in (list(history)[5], list(history)[30], list(history)[-1]):
        assert {bytes(r.k): bytes(r.v) for r in db.scan(seq).collect()} == history[seq]
    db.compact()
    assert {bytes(r.k): bytes(r.v) for r in db.scan().collect()} == model
    for k in (b"", b"a", b"bb", b"zz"):
        if k in model:
            assert db.get(k) == model[k]
        else:
            with pytest.raises(StoreError):
                db.get(k)
    db.close()
    with pytest.raises(StoreError):
        Database(spark, str(tmp_path / "db"), Options(comparator="other"))
    with pytest.raises(StoreError):
        Database(spark, str(tmp_path / "none"), Options(create_if_missing=False))


def test_streaming_ingest(spark, tmp_path):
    for i in range(3):
        part = [(f"k{j}".encode(), i * 10 + j + 1, 1, str(i).encode()) for j in range(4)]
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ingest.source(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    ingest.ingest(stream, f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination()
    got = resolve.live(ingest.ingested(spark, f"{tmp_path}/log"))
    assert [(bytes(r.k), bytes(r.v)) for r in got.orderBy("k").collect()] == [(f"k{j}".encode(), b"2") for j in range(4)]


def test_crc32c_of_every_payload(spark, tmp_path):
    from tidelog.plans.queries import QUERIES

    def crc(data):
        c = 0xFFFFFFFF
        for b in data:
            c ^= b
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    rows = [(i, t) for i, t in enumerate(["", "{}", '{"k": 1}', "é東" * 700, "x" * 9001, '{"k": 1}'])] + [(9, None)]
    spark.createDataFrame(rows, "event_id bigint, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["crc32c_props"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(i, None if t is None else crc(t.encode())) for i, t in rows]


def test_database_prunes_and_bounds(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    for part in (b"ab", b"mn", b"yz"):
        for c in part:
            db.put(bytes([c]), b"v" + bytes([c]))
        db.flush()
    assert len(db._tables(b"m", b"n").inputFiles()) == 1 and db._tables(b"c", b"l").count() == 0
    assert db.get(b"n") == b"vn"
    assert rows(db.scan(low=b"b", high=b"y")) == [(b"b", 2, b"vb"), (b"m", 3, b"vm"), (b"n", 4, b"vn")]
    snap = db.last_seq
    db.delete(b"b")
    cursor_ = db.cursor().seek_to_first()
    assert cursor_.next().key() == b"m" and db.cursor(snap).seek(bytearray(b"b")).key() == b"b"
    assert db.versions().seek(bytearray(b"b"))._here().op == 0
    db.close()


def test_database_refuses(spark, tmp_path):
    with pytest.raises(StoreError):
        Database(spark, str(tmp_path / "other"), Options(comparator="other"))
    db = Database(spark, str(tmp_path / "db"))
    db.put(b"a", b"1")
    for bad in ([(b"b", 1, 1, b"x")], [(b"b", 5, 1, b"x"), (b"b", 5, 1, b"y")]):
        with pytest.raises(StoreError):
            db.append(spark.createDataFrame(bad, LOG))
    db.append(spark.createDataFrame([(b"b", 5, 1, b"x")], LOG))
    assert db.last_seq == 5 and db.get(b"b") == b"x"
    db.put(b"c", b"3")
    db._add_table = lambda *a, **k: 1 / 0  # a flush that fails
    with pytest.raises(ZeroDivisionError):
        db.flush()
    for again in (lambda: db.put(b"d", b"4"), db.flush):
        with pytest.raises(StoreError):
            again()
    db.close()
    back = Database(spark, db.path)
    assert (back.get(b"a"), back.get(b"b"), back.get(b"c"), back.last_seq) == (b"1", b"x", b"3", 6)
    back._state.next_file = 1
    with pytest.raises(StoreError):
        back._publish()
    back.close()
    (tmp_path / "db" / (tmp_path / "db" / "CURRENT").read_text().strip()).write_bytes(b"\1" * 40)
    with pytest.raises(StoreError):
        Database(spark, db.path)


def test_crc32c_of_long_bytes():
    rng = random.Random(9)
    for n in (255, 256, 257, 1000, 4096, 70_001):
        data, c = rng.randbytes(n), 0xFFFFFFFF
        for b in data:
            c = codec.CRC_TABLE[(c ^ b) & 255] ^ (c >> 8)
        assert codec.crc32c_bytes(data) == c ^ 0xFFFFFFFF


def test_byte_keys_spread_over_ranges(spark):
    urls = [f"https://site{i % 97}.org/page/{i}" for i in range(5000)] + ["ftp://one", "", "zzz"]
    keys_ = spark.createDataFrame([(u.encode(),) for u in urls], "k binary")
    got = cursor.ranged(keys_, keys_, "k", 8).collect()
    sizes = [sum(r._b == b for r in got) for b in range(8)]
    assert sum(sizes) == len(urls) and max(sizes) < 2 * len(urls) / 8
    line = sorted((bytes(r.k), r._b) for r in got)
    assert [b for _, b in line] == sorted(b for _, b in line)
    found = cursor.neighbours(keys_, keys_.select(F.col("k").alias("t")), "gt").collect()
    order = sorted(u.encode() for u in urls)
    assert {bytes(r.t): r.found and bytes(r.found) for r in found} == dict(zip(order, [*order[1:], None]))


def test_rotation_over_groups_of_blocks(spark):
    log = spark.range(1, 30_000, 7).select(F.col("id").alias("seq"), F.lit(1).alias("op"), (F.col("id") % 50 + 1).alias("sz"))
    got = batch.rotation(log, "sz", 1000, 2).orderBy("seq").collect()
    total = 0
    for r in got:
        total += r.sz
        assert (r.cum_bytes, r.buffer) == (total, (total - 1) // 1000)


def test_crc32c_of_rows(spark):
    rng = random.Random(4)
    rows = [None, b"", b"123456789", *(rng.randbytes(n) for n in (1, 2, 255, 256, 300, 5000)), None, b"123456789"]
    want = [None if x is None else codec.crc32c_bytes(x) for x in rows]
    for kind in (pa.binary(), pa.large_binary()):
        data = pa.array(rows, kind)
        assert codec.crc32c_rows(data).to_pylist() == want
        assert codec.crc32c_rows(data[2:7]).to_pylist() == want[2:7] and codec.crc32c_rows(data[:0]).to_pylist() == []
    df = spark.createDataFrame(list(enumerate(rows)), "i int, x binary")
    assert dict(df.select("i", codec.crc32c(F.col("x"))).collect()) == dict(enumerate(want))


def test_replay_of_a_batch():
    said = []
    made = WriteBatch().put(b"a", b"1").delete(b"b").put(b"", b"")
    made.replay(lambda k, v: said.append((k, v)), lambda k: said.append((k,)))
    assert said == [(b"a", b"1"), (b"b",), (b"", b"")]


def test_unfinished_table_is_abandoned(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    bad = spark.range(3, 6).select(F.lit(b"k").alias("k"), F.col("id").alias("seq"), F.lit(1).alias("op"), F.raise_error(F.lit("no value")).cast("binary").alias("v"))
    with pytest.raises(Exception, match="no value"):
        db.append(bad)
    assert not list((tmp_path / "db").glob("*.ldb"))
    with pytest.raises(StoreError):
        db.put(b"a", b"1")
    db.close()


def test_large_and_many_filters(spark):
    """Filters of more keys than a batch holds, and many filters a batch, are the plain ones' bytes; probes beside groups without one match nothing."""
    many = spark.range(40_000).select(F.when(F.col("id") < 25_000, F.col("id") % 2).otherwise(F.col("id") % 3000).alias("g"), F.encode(F.col("id").cast("string"), "UTF-8").alias("k"))
    groups = {}
    for g, k in [*((r.g, bytes(r.k)) for r in many.collect()), (5, None), (3001, None)]:
        groups.setdefault(g, []).append(k)
    built = filters.build_filters(many.unionByName(spark.createDataFrame([(5, None), (3001, None)], "g bigint, k binary")), "g")
    plain = {g: filters.build(sorted({filters.fnv1_bytes(k or b"") for k in ks})) for g, ks in groups.items()}
    assert {r.g: (bytes(r.filter), r.n_keys) for r in built.collect()} == {g: (plain[g], len({filters.fnv1_bytes(k or b"") for k in ks})) for g, ks in groups.items()}
    asked = many.unionByName(spark.createDataFrame([(9000, b"1"), (None, b"1"), (0, b"absent"), (3001, None)], "g bigint, k binary"))
    for spread in (1, 4):
        got = filters.probe_filters(asked.withColumn("q", F.encode(F.concat(F.decode("k", "UTF-8"), F.lit("/x")), "UTF-8")), built, "g", F.col("q"), spread).collect()
        assert len(got) == 40_004 and all(r.may_match == (r.g in plain and filters.matches(bytes(r.q or b""), plain[r.g])) for r in got)


def test_filters_arent_sent_with_each_probe(spark):
    """A join would send a filter with each of its probes: as large as both together."""
    from tidelog.plans.queries import QUERIES

    data = "/root/testdata/sf0.001"
    for name in ("bloom_absent", "bloom_probe", "filter_block"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
        assert "may_match" in plan and "Join LeftOuter" not in plan and "Join Inner, (" not in plan, plan


def test_hashes_of_rows(spark):
    rng = random.Random(6)
    rows = [None, b"", b"hello", *(rng.randbytes(n) for n in (1, 2, 255, 5000)), None, b"world"]
    want = [filters.fnv1_bytes(x or b"") for x in rows]
    assert filters.fnv1_rows(pa.array(rows, pa.binary())).to_pylist() == want
    assert filters.fnv1_rows(pa.array(rows, pa.large_binary())[2:5]).to_pylist() == want[2:5] and filters.fnv1_rows(pa.array([], pa.binary())).to_pylist() == []
    df = spark.createDataFrame([(x,) for x in rows], "x binary")
    assert [tuple(r) for r in df.select(filters.fnv1(F.col("x")), filters.fnv1_batched(F.col("x"))).collect()] == [(w, w) for w in want]


def test_a_task_sorts_few_rows(spark, tmp_path, monkeypatch):
    """Tables of many rows are cut into more files than asked for, in bulk loads and compactions alike; metadata isn't from a sort of each file."""
    monkeypatch.setattr(storage, "ROWS_PER_FILE", 100)
    log = spark.createDataFrame([(f"{i * 7919 % 300:04d}".encode(), i, i % 5 and 1, b"v" if i % 5 else None) for i in range(1, 1000)], LOG)
    meta = storage.write_sorted(log, f"{tmp_path}/t", 2)
    files = sorted(meta.collect(), key=lambda r: bytes(r.smallest.k))
    assert len(files) == 10 and max(r.n for r in files) < 300
    line = sorted(rows(log), key=lambda r: (r[0], -r[1], -r[2]))
    for r in files:
        mine, line = line[: r.n], line[r.n :]
        assert [(bytes(e.k), e.seq, e.op) for e in (r.smallest, r.largest)] == [m[:3] for m in (mine[0], mine[-1])]
    assert not line
    assert "= last#" in meta._jdf.queryExecution().optimizedPlan().toString()
    db = Database(spark, str(tmp_path / "db"))
    db.append(log, files=2)
    assert len(db._tables().inputFiles()) == 10 and db.log().count() == 999
    with pytest.raises(StoreError):
        db.append(spark.range(300).select(F.lit(b"k").alias("k"), (F.col("id") % 299 + 1000).alias("seq"), F.lit(1).alias("op"), F.lit(b"v").alias("v")))
    db.put(b"0001", b"w")
    want = rows(db.scan())
    db.compact(files=3)
    assert len(db._tables().inputFiles()) == 10 and rows(db.scan()) == want and db.get(b"0001") == b"w"
    db.close()


def test_codecs_beyond_small_numbers(spark, tmp_path):
    """Bytes and lengths of numbers that the SQL twins have no branch for."""
    from tidelog.plans.queries import QUERIES

    ids = [0, 1, 127, 128, 65_534, 65_535, 65_536, 2_049_125, 2_049_126, 9_000_000, 1 << 40]
    spark.createDataFrame([(i, i % 90_000) for i in ids], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.id: r.enc for r in QUERIES["varint_encode"](spark, str(tmp_path)).collect()}
    assert got == {i: codec.put_varint(i * 131).hex().upper() for i in ids}
    got = {r.id: r.len for r in QUERIES["varint_len"](spark, str(tmp_path)).collect()}
    assert got == {i: len(codec.put_varint(i * (i % 90_000))) for i in ids}
    spark.createDataFrame([(i, 7, "view", 1.0) for i in ids], "event_id bigint, user_id bigint, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.seq - 1: r.packed for r in QUERIES["pack_tag"](spark, str(tmp_path)).collect()}
    assert got == {i: (b"7" + struct.pack("<Q", (i + 1) << 8 | 1)).hex().upper() for i in ids}
