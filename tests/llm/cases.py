"""Small documents with every odd case: nulls, blanks, repeats, long texts, ties, clashing columns."""

import random

import pyarrow as pa

WORDS = "alpha beta gamma delta épsilon zêta eta theta iota kappa lambda mü nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng: random.Random, n: int, line: int = 12) -> str:
    words = [rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "ed", "tion"]) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + line]) for i in range(0, n, line))


def texts(seed: int = 0) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    long_passage = prose(rng, 60, 60)
    body = [prose(rng, rng.randint(5, 120)) for _ in range(30)]
    near = body[3].split(" ")
    near[len(near) // 2] = "changed"
    docs: list[tuple[int | None, str | None]] = list(enumerate(body))
    docs += [(100, None), (101, ""), (102, " \t\r\n\x0b\x0c "), (103, "one"), (104, "one two"), (105, "\x00\x00 nul \x00"), (106, "日本語 と 🙂 emoji wide")]
    docs += [(107, body[3]), (108, body[3]), (109, " ".join(near)), (110, body[5] + "\n" + long_passage), (111, long_passage + " " + body[7])]
    docs += [(112, "word " * 400), (113, "a" * 700), (114, long_passage + "\n" + long_passage), (115, prose(rng, 4000)), (116, "<|endoftext|> x <|endoftext|>"), (117, "  double  spaces   \n\n run ")]
    docs += [(5, body[5]), (5, body[5]), (None, body[9]), (None, None)]
    rng.shuffle(docs)
    return docs


def frame(spark, rows=None):
    """With columns whose names clash with those that operators use inside."""
    rows = texts() if rows is None else rows
    return spark.createDataFrame(
        pa.table({
            "doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()),
            "lang": pa.array([None] * len(rows), pa.string()), "source": pa.array(["s"] * len(rows)), "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64()),
            "block": pa.array(["clash"] * len(rows)), "bucket": pa.array([1.5] * len(rows)), "key": pa.array([[1]] * len(rows), pa.list_(pa.int64())), "fp": pa.array([True] * len(rows)),
        })
    ).repartition(3)


def empty(spark):
    return frame(spark).where("false")


def rows_of(df, *cols):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=key)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))
