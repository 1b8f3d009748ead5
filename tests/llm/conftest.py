import random

import pytest


@pytest.fixture(scope="session")
def corpus(spark, tmp_path_factory):
    """Small texts with copies, near copies, shared passages, secrets and junk, and their table."""
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdeiourstn") for _ in range(r.randint(1, 7))) for _ in range(300)]

    def prose(n):
        return [r.choice(vocabulary) for _ in range(n)]

    passage, line = prose(60), " ".join(prose(9)) + "."
    texts = []
    for k in range(240):
        w = prose(r.choice([0, 3, 12, 60, 150, 400]))
        if k % 3 == 0:
            w = w[:20] + passage + w[20:]
        if k % 7 == 0:
            w.append(r.choice(["password=hunter22x", "API_KEY: 'short'", "token:'abcDEF123=='", "AKIA" + "Q7" * 9, "0123456789abcdef" * 3]))
        texts.append(" ".join(w) + ("\n" + line) * r.choice([0, 0, 1, 3]))
    for k in range(60):
        w = texts[k].split(" ")
        if k % 2 and len(w) > 40:
            w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [" | ".join(prose(30)), "wow!! " * 40, " ".join(prose(10) * 9), "a  b\n\n c   d \n", "<|endoftext|> tail", None]
    rows = [(k, t, f"s{0 if k % 3 else k % 5}") for k, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("corpus") / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(path)
    return {k: t or "" for k, t, _ in rows}, spark.read.parquet(path)
