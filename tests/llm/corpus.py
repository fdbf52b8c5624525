"""Small tables with nulls, empty and long texts, ties, repeated rows, near copies and shared passages."""

from __future__ import annotations

import random
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

SYLLABLES = ["ba", "ko", "re", "Ti", "su", "né", "lo", "ßa", "mi", "語", "du", "va", "Öl", "x7"]


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    word = lambda k: "".join(SYLLABLES[(k * 7 + j * j + k // 9) % len(SYLLABLES)] for j in range(1 + k % 4))
    return " ".join(word(int(vocabulary * rng.random() ** 2)) + rng.choice(["", "", "", ",", ".", "  ", "\n"]) for _ in range(n))


def texts(seed: int = 1) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([3, 8, 30, 120, 300])) for _ in range(40)]
    passage, line = prose(rng, 60), "All rights reserved. " * 15
    out: list[str | None] = [None, "", " \n\t", "one", "one", "two words", "aaaa " * 200, "a" * 700, "a" * 431]
    out += base
    out += [base[k] for k in (0, 1, 2, 3, 3, 3, 4)]
    for k in range(12):
        words = base[k + 5].split(" ")
        words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
        out.append(prose(rng, 20) + " " + passage + " " + prose(rng, 15))
        out.append(line + base[k])
    out.append(prose(rng, 6000))
    out.append(out[-1][:20000] + " tail")
    ids = list(range(5, 5 + len(out)))
    rng.shuffle(ids)
    return list(zip(ids, out))


def items(docs: list[tuple[int, str | None]]) -> list[tuple[int, str | None]]:
    long = [t for _, t in docs if t and len(t.split()) > 40]
    cut = lambda t, a, n: " ".join(t.split()[a : a + n])
    return [(1, cut(long[0], 3, 30)), (2, cut(long[1], 0, 13).upper()), (3, "one"), (10, cut(long[2], 5, 6)), (11, cut(long[2], 5, 6)), (4, None), (5, ""), (6, "nothing like any document has here"), (7, cut(long[3], 2, 20) + " ending anew with other words than those before it there")]


def write(folder: Path, docs: list[tuple[int, str | None]], labels: list[tuple] = (), benchmark: list[tuple] = (), langs: list | None = None, extra: bool = True) -> str:
    """The tables as Parquet; with extra, columns whose names operators might use for their own."""
    n = len(docs)
    table = {"doc_id": pa.array([i for i, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs], pa.string()), "lang": pa.array(langs or [None] * n, pa.string()), "source": pa.array(["s"] * n, pa.string()), "n_chars": pa.array([None if t is None else len(t) for _, t in docs], pa.int64())}
    if extra:
        table |= {"block": pa.array(range(n), pa.int64()), "label": pa.array(["x"] * n, pa.string()), "score": pa.array([None] * n, pa.float64()), "bucket": pa.array([1] * n, pa.int32())}
    folder.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table(table), folder / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([x[1] for x in labels], pa.int32()), "toxic": pa.array([x[2] for x in labels], pa.int32())}), folder / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([x[0] for x in benchmark], pa.int64()), "text": pa.array([x[1] for x in benchmark], pa.string())}), folder / "benchmark.parquet")
    return str(folder)
