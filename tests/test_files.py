"""Binary table and manifest files."""

import struct

import pytest

from tidelog.schema import StoreError
from tidelog.sources import manifest_file, table_file


@pytest.mark.parametrize("kind", [table_file.PLAIN, table_file.SNAPPY])
def test_table_file(spark, tmp_path, kind):
    rows = [(f"{i // 3:05d}".encode(), 10 - i % 3, int(i % 7 > 0), b"v" * (i % 40) if i % 7 else None) for i in range(2000)]
    data = table_file.encode_table(rows, compression=kind)
    assert list(table_file.decode_table(data)) == rows
    (tmp_path / "000005.ldb").write_bytes(data)
    broken = bytearray(data)
    broken[50] ^= 1
    (tmp_path / "000006.ldb").write_bytes(broken)
    got = table_file.read_tables(spark, f"{tmp_path}/*.ldb").collect()
    assert sum(r.status == "OK" for r in got) == 2000 and any(r.status == "Corruption" for r in got)
    assert list(table_file.decode_table(table_file.encode_table([]))) == []
    with pytest.raises(StoreError):
        table_file.encode_table([(b"b", 1, 1, b""), (b"a", 1, 1, b"")])
    with pytest.raises(StoreError):
        table_file.decode_footer(b"x" * 60)


def test_city_and_height():
    data = table_file.encode_table([(b"city", 1, 1, b"shenzhen"), (b"height", 2, 1, b"160")])
    meta, index = table_file.decode_footer(data)
    assert struct.unpack("<Q", data[-8:])[0] == table_file.MAGIC and meta.offset < index.offset
    keys = [k for k, _, _, _ in table_file.decode_table(data)]
    assert (keys[0], keys[-1], len(keys)) == (b"city", b"height", 2)


def test_manifest_record():
    edit = {"comparator": "bytewise", "log_number": 0, "next_file": 2, "last_seq": 1 << 40, "deleted": [(0, 5)], "added": [(1, 8, 1 << 36, b"a" * 9, b"z" * 9)]}
    assert manifest_file.decode_edit(manifest_file.encode_edit(edit)) == edit
    for bad in (b"\x09", b"\x01\x05ab", b"\x02"):
        with pytest.raises(StoreError):
            manifest_file.decode_edit(bad)
