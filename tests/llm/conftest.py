import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "kept boolean, fp string, size int, spans string, h double, uid string, n_words string")
WORDS = ("river stone light garden winter table music paper window silver morning forest "
         "bridge candle letter market shadow island thunder copper").split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n)]
    return "\n".join(" ".join(out[i:i + 12]).capitalize() + "." for i in range(0, n, 12))


PASSAGE = prose(99, 80)
TEXTS = [
    None, "", " \t\n ", "one", "one two", "Ünïcödé ñandú 😀 ſtraße",
    prose(1, 60), prose(1, 60), prose(2, 300), prose(3, 40) + "\n" + PASSAGE,
    PASSAGE + "\n" + prose(4, 40), "spam ham " * 400, "ab" * 3000, "é" * 700,
    prose(5, 20_000), "Home | About | Contact | News | Login\n" + prose(6, 100),
    "Released under the MIT License.\n" + prose(7, 30), "x" * 120_000,
]


def _row(doc_id, text, source):
    return (doc_id, text, "en", source, None if text is None else len(text), True, "f", 1, "s",
            0.5, "u", "w")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, blank, long and repeated texts, ties, clashing columns."""
    rows = [_row(i, t, ("a", "b", None)[i % 3]) for i, t in enumerate(TEXTS)]
    rows += [_row(6, TEXTS[6], "a")] * 3 + [_row(None, TEXTS[8], None), _row(None, None, "b"),
                                            _row(8, prose(8, 50), "c")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
