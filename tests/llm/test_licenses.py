import re

import pytest

from tests.llm.brute import ALNUM, fold
from veedor.llm.licenses import PHRASES, TEMPLATES, WHOLE, compile_template, scan_licenses

ROWS = [
    (1, None), (2, ""), (3, "Released under the MIT License."), (4, "the mit. license; MIT license"), (5, "mit licenses"),
    (6, "Licensed under the GNU General Public License, version 3."), (7, "licensed under the gnu lesser general public license"),
    (8, "Licensed under CC BY-NC 4.0."), (9, "Copyright (c) 2020 A B, all rights reserved " + "x " * 9000 + "apache license"), (10, "mit " * 200),
    (11, "copyright " + "w " * 13 + "all rights reserved"), (11, "mit license"), (None, "Apache License"),
]


def pattern(template):
    out = ""
    for part in re.sub(r"([\[\]])", r" \1 ", template).split():
        many = re.fullmatch(r"\{(\d+)\}", part)
        out += {"[": "(?:", "]": ")?"}.get(part) or (r"(?:\S+ ){0,%s}" % many[1] if many else re.escape(part) + " ")
    return re.compile(r"(?<!\S)" + out)


def test_against_patterns(table):
    found = scan_licenses(table(ROWS)).collect()
    base, every = [(pattern(p), n) for p, n in PHRASES], [(pattern(p), n) for p, n in (*PHRASES, *TEMPLATES)]
    want = []
    for i, text in ROWS:
        words = ALNUM.findall(fold(text))
        line = " ".join(words) + " "
        at = [(line[: m.start()].count(" "), n) for p, n in base for m in p.finditer(line)]
        places = [k for k, _ in at]
        labels = sorted({n for p, n in every if p.search(line)})
        want.append((i, len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({n for _, n in at})), ",".join(labels)))
    got = [(r.id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in found]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert all(0 <= r.score <= 1 and (r.score == 1) == bool(r.labels) for r in found)


def test_regions():
    a = compile_template("x [a [b] c] y {2} z", "l")
    from veedor.llm.arrays import ALNUM as KIND, hash_texts

    run = lambda t: a.run([int(h) for h in hash_texts([t], KIND)[0]], 0)
    assert [run(t) for t in ("x y z", "x a c y q z", "x a b c y q r z")] == [1.0] * 3
    assert run("x y q r s z") == pytest.approx(2 / 3) and run("x b y z") == pytest.approx(1 / 3)


@pytest.mark.parametrize("bad", ["", "[a] b", "{3} a", "a [b"])
def test_bad_templates(bad):
    with pytest.raises(ValueError):
        compile_template(bad, "l")


NAME = "acme widget holders"


def written(template, name=NAME):
    """A text that the template accepts: no optional words, ``name`` in the replaceable regions."""
    plain = re.sub(r"\[[^\]]*\]", " ", template)
    return re.sub(r"\{\d+\}", name, plain).upper()


def test_whole_wording(table):
    rows = [(k, f"Copyright X.\n\n{written(t)}\nmore words") for k, (t, _) in enumerate(WHOLE)]
    found = {r.id: (r.labels, r.score) for r in scan_licenses(table(rows)).collect()}
    assert found == {k: (label, 1.0) for k, (_, label) in enumerate(WHOLE)}


def test_changed_wording_is_not_accepted(table):
    rows = []
    for k, (template, _) in enumerate(WHOLE):
        words = written(template).split()
        for at in (len(words) // 3, len(words) // 2, len(words) - 1):
            while not {words[at - 1], words[at]}.isdisjoint(NAME.upper().split()):  # a word more in a name changes nothing
                at += 1
            rows.append((k, " ".join([*words[:at], "QUITE", *words[at:]])))
        rows.append((k, " ".join(words[:-1])))
    found = scan_licenses(table(rows)).collect()
    assert len(found) == len(rows) and [r for r in found if r.labels or not 0.3 < r.score < 1] == []


def test_wording_after_many_starts(table):
    text = "this software " * 500 + written(dict((n, t) for t, n in WHOLE)["zlib"]) + " this" * 40
    assert [(r.labels, r.score) for r in scan_licenses(table([(1, text)])).collect()] == [("zlib", 1.0)]


def test_empty(table):
    assert scan_licenses(table([])).count() == 0
