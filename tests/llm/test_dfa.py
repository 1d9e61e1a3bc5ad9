import random
import re

import pytest

from cairn.llm import dfa
from cairn.llm.anchored import Patterns, alternatives, required
from cairn.llm.dfa import Automaton

RULES = {
    "token": [r"(?<![0-9A-Za-z_])AKIA[0-9A-Z]{16}", r"gh[ps]_[0-9a-z]{6,}"],
    "alone": [r"^[^\w\n]{0,3}[A-Za-z0-9][\w.]{3,}[ \t]*\r?$"],
    "name": [r"(?i)passw(?:ord|d)\s*[:=]", "пароль:"],
    "url": [r"://[^\s/:@]*:[^\s/]+@"],
}
PIECES = ["AKIA" + "B2" * 8, "ghp_abc123xyz", "password =", "PASSWD:", "пароль: x", "http://u:p@h", "http://h/x", "word", "\n", "\n", " ", " ", "é", "x.y", "#", "AKIA", "ghp_", "\r\n", "passw", "日本", "a" * 300]


@pytest.mark.parametrize("size, rounds", [(5, 60), (60, 60), (4000, 4)])
def test_no_match_of_any_pattern_is_missed(size, rounds):
    rng, automaton = random.Random(size), Automaton(RULES)
    for _ in range(rounds):
        texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(size))) for _ in range(rng.randrange(1, 6))]
        for text, got in zip(texts, automaton.lines(texts)):
            for name, patterns in RULES.items():
                for m in (m for p in patterns for m in re.finditer(p, text, re.M)):
                    # Where the match ends lies the line; those of one line are meant here.
                    if "\n" not in m[0]:
                        assert name in got.get(text.rfind("\n", 0, m.start()) + 1, set())


def test_hits_do_not_depend_on_where_chunks_are_cut(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice(PIECES) for _ in range(3000)) + "b" * 9000 + "\n" + "".join(rng.choice(PIECES) for _ in range(500))
    chunked, whole = Automaton(RULES), Automaton(RULES)
    places = lambda a: [(at, a.found[s]) for at, s in a.places(text)]
    by_chunk = places(chunked)
    monkeypatch.setattr(dfa, "SHORT", 1 << 40)
    assert by_chunk == places(whole) and len(by_chunk) > 100


def test_states_may_be_forgotten_between_texts(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PIECES) for _ in range(50)) for _ in range(40)]
    whole = [Automaton(RULES).lines([t])[0] for t in texts]
    monkeypatch.setattr(dfa, "MOST_STATES", 8)
    automaton = Automaton(RULES)
    assert [automaton.lines([t])[0] for t in texts] == whole and automaton.lines(texts) == whole


def test_empty_texts():
    automaton = Automaton(RULES)
    assert automaton.lines([]) == [] and automaton.lines(["", "AKIA" + "B2" * 8, ""]) == [{}, {0: {"token", "alone"}}, {}]


def test_literals_of_patterns():
    assert alternatives(r"(?i)a|(?:b|c)|[|]|\|d") == ["(?i)a", "(?i)(?:b|c)", "(?i)[|]", r"(?i)\|d"]
    assert required(r"(?:page|file) not found\b") == {" not found"} and required(r"\w+") == set() and required(r"_{5,}") == {"_____"}
    p = Patterns({"x": r"abc\d|(?i:Def)", "y": r"\d\d"})
    hits = p.hits("zzabc1")
    assert p.search("x", "zzabc1", hits)[0] == "abc1" and p.search("x", "nothing", p.hits("nothing")) is None and p.search("y", "42", set())[0] == "42"
    assert p.names("abc") == {"x", "y"}
