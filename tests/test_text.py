import random
import sqlite3

import pytest

from lectern.functions.text import snippet_of, stem, stemmed_tokens
from lectern.operators.chunks import Strategy, spans, split_words


def numbered(n):
    return [f"word{k}" for k in range(n)]


def marked(n, at, *words):
    out = numbered(n)
    out[at : at + len(words)] = words
    return out


@pytest.mark.parametrize(
    ("words", "want"),
    [
        (numbered(499), []),
        (numbered(551), [(0, 299), (250, 550)]),
        (marked(700, 290, "end."), [(0, 290), (241, 540), (491, 699)]),
        (marked(700, 288, "Speaker", "2:"), [(0, 287), (238, 537), (488, 699)]),
        (marked(700, 288, "[SPEAKER", "2]:"), [(0, 287), (238, 537), (488, 699)]),
        (marked(700, 295, "Mr.", "3.14.", "wait..", "e.g."), [(0, 299), (250, 549), (500, 699)]),
        (marked(700, 297, "stop!", "x", "y", "z", "stop?"), [(0, 297), (248, 547), (498, 699)]),
    ],
)
def test_where_chunks_end(words, want):
    assert spans(words) == want


def test_every_word_is_covered_and_chunks_overlap():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randrange(500, 3000)
        words = [rng.choice(["a", "end.", "Speaker", "1:", "hey!", "Dr."]) if rng.random() < 0.1 else "w" for _ in range(n)]
        found = spans(words)
        assert found[0][0] == 0 and found[-1][1] == n - 1
        for (a, b), (c, d) in zip(found, found[1:]):
            assert a < c <= b + 1 and b < d and (c == b - 49 or c == a + 1)
        assert all(b - a + 1 <= 330 for a, b in found[:-1]) and found[-1][1] - found[-1][0] + 1 <= 430


def test_strategies_are_checked():
    for bad in ({"size": 0}, {"overlap": -1}, {"overlap": 300}):
        with pytest.raises(ValueError, match="overlap"):
            Strategy(**bad)
    assert split_words("  a b\n\nc ") == ["a", "b", "c"] and split_words(None) == []


def test_tokens_agree_with_full_text_search():
    """Two words share a stem here just where SQLite's Porter tokenizer finds one by the other."""
    words = "notifications notify notified corporate groups group relational hopping hoping sized agreed happy happiness probate rate ceasing controlling électrical naïveté generalization oscillators running ran flies died tied sky replacement adjustable triplicate formative hopeful goodness revival allowance inference".split()
    with sqlite3.connect(":memory:") as db:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize = 'porter unicode61 remove_diacritics 2')")
        db.executemany("INSERT INTO t VALUES (?)", [(w,) for w in words])
        db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
        theirs = dict(db.execute("SELECT doc, term FROM v").fetchall())
    assert [theirs[k + 1] for k in range(len(words))] == [stemmed_tokens(w, {})[0] for w in words]


def test_snippets_agree_with_full_text_search():
    """Marks and windows as SQLite cuts them, over two columns, for terms, phrases and prefixes."""
    rng = random.Random(9)
    filler = "alpha beta gamma delta. epsilon zeta: eta theta, Iota kappa mu. nu xi omicron".split()
    queries = [("notify", [(("notify",), False)]), ('"corporate group"', [(("corporate", "group"), False)]), ("queue OR bull", [(("queue",), False), (("bull",), False)]), ("gro*", [(("gro",), True)])]
    with sqlite3.connect(":memory:") as db:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(a, b, tokenize = 'porter unicode61 remove_diacritics 2')")
        rows = []
        for k in range(120):
            texts = []
            for _ in range(2):
                words = rng.choices(filler, k=rng.randrange(0, 60))
                for _ in range(rng.randrange(0, 4)):
                    words[rng.randrange(len(words) + 1) : 0] = rng.choice([["notified"], ["Corporate", "groups"], ["queues"], ["bulls"], ["queue", "bull"], ["Notifying", "notified"]])
                texts.append("  ".join(words) if k % 5 == 0 else " ".join(words))
            rows.append((k, *texts))
        db.executemany("INSERT INTO t (rowid, a, b) VALUES (?, ?, ?)", rows)
        compared = 0
        for match, phrases in queries:
            stems = [(tuple(stem(w) for w in terms) if not prefix else terms, prefix) for terms, prefix in phrases]
            for most in (5, 10):
                for column in (-1, 0, 1):
                    for k, want in db.execute("SELECT rowid, snippet(t, ?, '«', '»', '…', ?) FROM t WHERE t MATCH ?", (column, most, match)).fetchall():
                        texts = list(rows[k][1:]) if column < 0 else [rows[k][1 + column]]
                        assert snippet_of(texts, stems, most) == want, (match, most, column, texts)
                        compared += 1
    assert compared > 300


def test_snippets_of_odd_texts():
    assert snippet_of([""], [(("x",), False)]) == "" and snippet_of(["only this", None], [(("x",), False)]) == "only this"
    assert snippet_of([None], [(("x",), False)]) == "" and snippet_of(["— — x"], [(("x",), False)]) == "— — «x»"
