"""Documents with every oddity that an operator must take."""

import random

import pytest

from .rows import ODD


def with_clashes(spark, rows):
    """Extra columns whose names operators use inside."""
    extra = {"lang": "string", "source": "string", "fp": "long", "norm": "string", "key": "int", "block": "int", "shard": "long", "digest": "binary", "row": "string", "score": "double", "kept": "boolean", "text_sha256": "string", "n_tokens": "long", "slice": "int", "chosen": "boolean", "place": "string", "range": "int", "head": "string", "path": "string", "a b": "string"}
    data = [(i, t, "en" if k % 2 else None, f"src{k % 3}" if k % 4 else None, *[None] * (len(extra) - 2)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, " + ", ".join(f"`{n}` {t}" for n, t in extra.items()))


@pytest.fixture(scope="session")
def odd_docs(spark):
    return with_clashes(spark, ODD).repartition(3).persist()


@pytest.fixture(scope="session")
def empty_docs(spark):
    return with_clashes(spark, [])


@pytest.fixture(scope="session")
def prose():
    """Texts with exact copies, near copies and shared passages: (id, text)."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(30)
    out = [text(rng.randint(1, 150)) for _ in range(60)]
    out += [x.upper() for x in out[:6]] + [out[3]] * 4
    for i in range(10):
        copy = out[20 + i].split()
        copy[rng.randrange(len(copy))] = "changed"
        out.append(" ".join(copy))
    out += [f"{text(10)} {passage} {text(12)}" for _ in range(6)]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.fixture(scope="session")
def prose_docs(spark, prose):
    return with_clashes(spark, prose).repartition(4).persist()
