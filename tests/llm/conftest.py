import random

import public_tokenizers
import pytest

WORDS = "the of and river stone lamp über café niño straße it's we'll cloud seven 12 x9 — 日本 ok".split()


def prose(rng: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        w = rng.choice(WORDS) + rng.choice(["", "", "ing", "er", "tion"])
        out.append(w.capitalize() if rng.random() < 0.1 else w)
    seps = [rng.choice([" ", " ", " ", "  ", "\n", "\t"]) for _ in out]
    return "".join(w + s for w, s in zip(out, seps))


def texts() -> list:
    """Texts with copies, near copies, shared passages, repeats, odd characters, nothing at all, and one very long one."""
    rng = random.Random(5)
    base, passage = prose(rng, 220), prose(rng, 60)
    words = base.split(" ")
    near = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in range(3, len(words), 17)]
    out = [None, "", " \n\t", "one", "two words", "a b c", "ONE", "one", "a b c d", "A b C d"]
    out += [base, base, base + " end"] + near + [prose(rng, rng.randint(1, 150)) for _ in range(20)]
    out += [prose(rng, 40) + " " + passage + " " + prose(rng, 40) for _ in range(4)]
    out += [("same line here\n" * 6) + prose(rng, 60), "### $$$ %%% " * 30, "x" * 5000, "cc by CC BY all rights reserved\nGNU General Public License", "<|endoftext|> it's <|startoftext|>x", "é İΣς ſ K\xa0z \x1c q", "\r\n\x0b\x0c a\rb"]
    out += ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0 (the License)", passage + " " + passage, prose(rng, 30_000)]
    return out


@pytest.fixture(scope="session")
def vocabulary():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def corpus():
    return list(enumerate(texts()))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """Columns clash with names the operators use inside; other columns may be null."""
    rows = [(i, t, None if i % 3 else "en", "src", i, "x", 1.5, None) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block string, id double, token string").repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("doc_id < 0")
