import gzip
import random
import zlib

import pytest

from guidespan.functions import seq as S
from guidespan.sources import contigs as C
from guidespan.sources import fasta


def plain(text):
    """(id, sequence) of each record, line by line."""
    out = []
    for line in text.splitlines():
        if line.startswith(">"):
            out.append([(line[1:].split() or [""])[0], ""])
        elif out:
            out[-1][1] += "".join(line.split()).upper()
    return [(i, s) for i, s in out if i and s]


def blocked(data, size):
    """A file of gzip blocks that name their size, with the empty block at the end."""
    out = b""
    for part in [*(data[i : i + size] for i in range(0, len(data), size)), b""]:
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflate.compress(part) + deflate.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + (len(body) + 25).to_bytes(2, "little") + body + zlib.crc32(part).to_bytes(4, "little") + len(part).to_bytes(4, "little")
    return out


def made(rng, records, width):
    text = ""
    for k in range(records):
        bases = "".join(rng.choice("ACGTacgtN") for _ in range(rng.choice([0, 1, 40, 400])))
        text += f">r{k % 5} some > words {'x' * rng.choice([0, 30])}\n" + "".join(bases[i : i + width] + rng.choice(["\n", "\r\n", " \n"]) for i in range(0, len(bases), width))
    return text


def read_local(path, size, step):
    """Ranges read one by one and put together as the summed rows say, without Spark."""
    records, inside = [], False
    for n, start in enumerate(range(0, size, step)):
        reader = fasta.Reader(fasta.texts(str(path), size, start, min(size, start + step)), n == 0)
        held, pieces = len(records), list(reader.pieces())
        records += [[i, ""] for i in reader.ids]
        for record, lead, _, bases in pieces:
            if not (lead and inside) and (record or held):
                records[held + record - 1][1] += bases.decode()
        if reader.known or reader.in_header:
            inside = reader.in_header
    return [(i, s) for i, s in records if i and s]


@pytest.mark.parametrize("width", [7, 60, 10**6])
def test_ranges_of_every_size(tmp_path, width):
    for seed in range(6):
        text = made(random.Random(seed), 9, width) + random.Random(seed).choice(["", ">last", ">last\n", ">last\nAC"])
        if seed % 2:
            text = "; remark\n" + text
        for name, data in (("a", text.encode()), ("b", blocked(text.encode(), 37)), ("c", gzip.compress(text.encode()) + gzip.compress(b""))):
            (tmp_path / name).write_bytes(data)
            for step in (1, 2, 3, 17, 64, 1000, len(data)) if name == "a" else (50, 333, len(data)):
                assert read_local(tmp_path / name, len(data), step) == plain(text), (seed, name, step)


def whole(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.record, r.pos)):
        seq = out.setdefault((r.record, r.seq_id), [])
        assert r.pos == sum(map(len, seq))
        seq.append(r.bases)
    return sorted((i, "".join(s)) for (_, i), s in out.items())


def test_rows_of_files(spark, tmp_path):
    """Plain, blocked and whole gzip files, told by their first bytes, equal the plain reading; limits and names; no record is an error."""
    text = made(random.Random(7), 12, 60) + ">big\n" + "ACGTTGCA" * 6_000 + "\n"
    folder = tmp_path / "in"
    folder.mkdir()
    for name, data in (("a.fa", text.encode()), ("b.fa", blocked(text.encode(), 900)), ("c.fa", gzip.compress(text.encode()))):
        (folder / name).write_bytes(data)
        for size in (500, 7_000, fasta.RANGE):
            assert whole(fasta.from_fasta_ranges(spark, str(folder / name), size=size)) == sorted(plain(text)), (name, size)
    assert whole(fasta.from_fasta_ranges(spark, str(folder), size=5_000)) == sorted(plain(text) * 3)
    assert whole(fasta.from_fasta_ranges(spark, str(folder / "a.fa"), ["r1"], size=300)) == sorted(x for x in plain(text) if x[0] == "r1")
    every = [[(line[1:].split())[0], 0] for line in text.splitlines() if line.startswith(">")]
    first = [x for x in plain(text[: [i for i, c in enumerate(text) if c == ">" and (i == 0 or text[i - 1] == "\n")][4]])]
    assert len(every) == 13 and whole(fasta.from_fasta_ranges(spark, str(folder / "a.fa"), max_records=4, size=300)) == sorted(first)
    assert whole(fasta.from_fasta_ranges(spark, str(folder / "a.fa"), ["big"], 1, size=300)) == [("big", "ACGTTGCA" * 6_000)]
    (tmp_path / "none.fa").write_text("no header\n")
    (tmp_path / "empty.fa").write_text("")
    for name in ("none.fa", "empty.fa"):
        with pytest.raises(ValueError, match="no sequence records"):
            C.checked(fasta.from_fasta_ranges(spark, str(tmp_path / name)))


def test_one_record_is_read_by_several_tasks(spark, tmp_path):
    """Chunks, windows and stretches of one record without line breaks are those of the whole sequence."""
    rng = random.Random(1)
    seq = "".join(rng.choices("ACGT", k=200_000))
    (tmp_path / "one.fa").write_text(f">chr1\n{seq}\n")
    rows = fasta.from_fasta_ranges(spark, str(tmp_path / "one.fa"), size=20_000)
    assert fasta.ranges(spark, str(tmp_path / "one.fa"), 20_000)[1] == 11 == rows.select("record", "pos").rdd.getNumPartitions()
    held = spark.createDataFrame([("chr1", seq)], "seq_id string, seq string")
    for overlap in (0, 22, 1024):
        assert sorted(map(tuple, C.chunks(rows, overlap).collect())) == sorted(map(tuple, C.chunks(held, overlap).collect()))
    sites = C.windows(rows, 23, "[ACGT]{20}" + S.pattern("NGG"))
    assert sorted(map(tuple, sites.collect())) == sorted(map(tuple, C.windows(held, 23, "[ACGT]{20}" + S.pattern("NGG")).collect()))
