"""Secrets that no pattern knows, and strings that the corpus explains."""

import string

import numpy as np
import pytest

from lumenrisk.llm import secrets


def random_string(rng, n=22):
    return "".join(rng.choice(list(string.ascii_letters + string.digits), n - 2)) + "7x"


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans] for r in secrets.scan(docs.repartition(3)).collect()}


def test_planted_secrets_are_found_by_novelty_alone(spark):
    rng = np.random.default_rng(1)
    made = [random_string(rng) for _ in range(40)]
    frames = ['the client secret is "{}" today', "Authorization with bearer {} was sent", "my passphrase ({}) stays here", "credential\n{}\nend", "signature {} of the request"]
    texts = [frames[i % 5].format(s) for i, s in enumerate(made)] + ["plain words about tokens and passwords in general"] * 20
    got = found(spark, texts)
    assert all(not secrets.base_spans(t) for t in texts)
    assert sum(got[i] == [("novel", s)] for i, s in enumerate(made)) >= 38
    assert all(got[i] == [] for i in range(40, 60))


def test_marks_inside_a_secret_and_mail_addresses(spark):
    got = found(spark, ['client secret is "q9X!z7Lm#2pT"', "ask for the token at jx83kq.w2@corp-mail7.net please"])
    assert got == {0: [("novel", "q9X!z7Lm#2pT")], 1: []}


def test_frequent_names_of_the_corpus_explain_a_string(spark):
    """A long mixed name near a sensitive word is news alone, but not in a corpus that uses its parts; a repeated secret stays one."""
    names = ["zygoteMarzipan", "quixoticFjordBanjo", "wyvernJukeboxQuartz"]
    odd = "the token for zygoteQuartz7MarzipanFjordBanjoJukebox stays"
    many = [f"secret {' '.join(names)} number" for _ in range(12)]
    rng = np.random.default_rng(2)
    secret = random_string(rng, 30)
    words = secrets.corpus_words(spark.createDataFrame([(i, t) for i, t in enumerate([*many, *[f"bearer {secret}"] * 50, None, ""])], "doc_id long, text string")).split()
    assert {"zygote", "Marzipan", "quixotic", "Fjord", "Banjo", "wyvern", "Jukebox", "Quartz", "number", "secret"} <= set(words)
    around = (odd[:14], odd[-6:])
    name = odd[14:-6]
    assert secrets.novelty(name, " ".join([*words, *around])) < secrets.novelty(name, " ".join(around)) - 0.05
    got = found(spark, [*many, *[f"bearer {secret}"] * 50])
    assert all(got[i] == [("novel", secret)] for i in range(12, 62)) and all(got[i] == [] for i in range(12))


def test_counting_parts_is_linear():
    assert len(secrets.parts_near("secret wordOne " * 50_000)) == 3
    assert secrets.parts_near("no context at all") == set() and secrets.parts_near("") == set()


@pytest.mark.parametrize("text", ["", "   ", "token", "$$$$$$$$$$$$ secret ############"])
def test_no_candidates(text):
    assert list(secrets.candidates(text)) == []
