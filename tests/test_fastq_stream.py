"""A stream of FASTQ files: late names, restarts, shared logs, and keys that do not depend on how files are split."""

import os
import threading

from helixloom.sources import fastq


def write(folder, name, n=3):
    folder.mkdir(exist_ok=True)
    folder.joinpath(name).write_text("".join(f"@{name}-{k}\nACGT{'A' * k}\n+\n{'I' * (4 + k)}\n" for k in range(n)))


def run(stream, out, checkpoint):
    query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    assert query.awaitTermination(120)


def rows(spark, out):
    return [(r.id, r.read_idx) for r in spark.read.schema(fastq.READS).parquet(str(out)).collect()]


def test_late_files_are_read_once_and_restarts_keep_keys(spark, tmp_path):
    fastq.register(spark)
    folder, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    for names in (["b.fastq", "c.fastq"], ["a.fastq"], [], ["bb.fastq", "_ignored.fastq"]):
        for name in names:
            write(folder, name)
        run(fastq.stream(spark, str(folder)), out, checkpoint)
    found = rows(spark, out)
    assert sorted(i for i, _ in found) == sorted(f"{f}.fastq-{k}" for f in ("a", "b", "bb", "c") for k in range(3))
    assert len({key for _, key in found}) == 12
    again = tmp_path / "again"
    run(fastq.stream(spark, str(folder), splitBytes=16), again, tmp_path / "check2")
    assert sorted(rows(spark, again)) == sorted(found)


def test_offsets_point_into_the_log(tmp_path):
    folder = tmp_path / "in"
    for name in ("b.fastq", "c.fastq"):
        write(folder, name)
    reader = fastq.FastqStreamReader({"path": str(folder)})
    first = reader.latestOffset()
    write(folder, "a.fastq")
    with open(folder / "b.fastq", "a") as out:
        out.write("@late\nA\n+\nI\n")
    restarted = fastq.FastqStreamReader({"path": str(folder)})
    second = restarted.latestOffset()
    assert (first, second, restarted.latestOffset()) == ({"files": 2}, {"files": 3}, {"files": 3})
    assert [(os.path.basename(p.file), p.ordinal) for p in restarted.partitions(first, second)] == [("a.fastq", 2)]
    names = [os.path.basename(p.file) for p in restarted.partitions({"files": 0}, first)]
    assert sorted(names) == ["b.fastq", "c.fastq"]
    read = [row for p in restarted.partitions({"files": 0}, first) for row in restarted.read(p)]
    assert len(read) == 6  # the size that the log has is what counts


def test_writers_of_one_log_agree(tmp_path):
    folder = tmp_path / "in"
    for k in range(40):
        write(folder, f"{k:02d}.fastq", 1)
    logs = [fastq.SeenLog(str(tmp_path / "log")) for _ in range(6)]
    tasks = [threading.Thread(target=lambda log=log, k=k: [log.append([str(folder / f"{x:02d}.fastq") for x in range(0, upto, 1 + k % 3)]) for upto in (10, 25, 40)]) for k, log in enumerate(logs)]
    [t.start() for t in tasks]
    [t.join() for t in tasks]
    seen = [[e["name"] for e in log.load()] for log in logs]
    assert all(s == seen[0] for s in seen) and len(set(seen[0])) == len(seen[0]) == 40
