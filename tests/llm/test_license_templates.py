import itertools

import pytest

from martloom.llm import license_templates as lic
from tests.llm.helpers import clashing, documents, edge_rows, prose


def every_text(template):
    """All texts that a template accepts, replaceable words being ``any``."""
    tokens = lic._TOKEN.findall(template)

    def sequence(at):
        done = [[]]
        while at < len(tokens) and tokens[at] != "]]":
            if tokens[at] == "[[":
                inner, at = sequence(at + 1)
                choices = [[], *inner]
            elif tokens[at].startswith("{"):
                choices = [["any"] * k for k in range(int(tokens[at][1:-1]) + 1)]
            else:
                choices = [[tokens[at]]]
            done = [a + b for a, b in itertools.product(done, choices)]
            at += 1
        return done, at

    return [" ".join(w) for w in sequence(0)[0]]


@pytest.mark.parametrize("template", ["a b c", "a [[b [[c]] d]] e", "a {2} b", "a [[x {1}]] [[y]] b", "a [[b]]", "a {3}"])
def test_automaton_accepts_just_the_variants(template):
    machine = lic.Automaton(template)
    accepted = {tuple(t.split()) for t in every_text(template)}
    for size in range(1, 6):
        for words in itertools.product(("a", "b", "c", "d", "e", "x", "y", "any") if size < 5 else ("a", "b", "x", "any"), repeat=size):
            longest = max((k for k in range(size + 1) if words[:k] in accepted or _any(words[:k], accepted)), default=-1)
            if any(w in words for w in ("c", "d", "e")) and "{" in template:
                continue
            assert machine.end_of([w.encode() for w in words], 0) == longest, words


def _any(words, accepted):
    return any(len(t) == len(words) and all(a in (b, "any") for a, b in zip(t, words, strict=True)) for t in accepted)


def filled(template):
    """The template with all options and no replaceable words."""
    return " ".join(t for t in lic._TOKEN.findall(template) if t not in ("[[", "]]") and not t.startswith("{"))


@pytest.mark.parametrize("label", lic.TEMPLATES)
def test_licences_are_found_and_changed_wording_is_not(label):
    scan = lic.Scanner().scan
    text = filled(lic.TEMPLATES[label])
    assert label in scan(prose(1, 50) + "\n" + text.upper().replace(" ", ",\n") + ". " + prose(2, 50))[3]
    words = lic.anchored(lic.TEMPLATES[label]).split("[[")[0].split("{")[0].split()
    broken = text.replace(" ".join(words), " ".join([*words[:-1], "WRONG"]))
    assert label not in scan(broken)[3]


def mandatory(template):
    out, depth = [], 0
    for t in lic._TOKEN.findall(template):
        depth += (t == "[[") - (t == "]]")
        if not depth and t != "]]" and not t.startswith("{"):
            out.append(t)
    return out


@pytest.mark.parametrize("label", lic.TEMPLATES)
def test_any_change_of_the_mandatory_wording_is_refused(label):
    scan = lic.Scanner({label: lic.TEMPLATES[label]}).scan
    words = mandatory(lic.TEMPLATES[label])
    assert scan(" ".join(words))[3] == [label]
    for k in range(len(words)):
        assert scan(" ".join([*words[:k], "wrong", *words[k + 1 :]]))[3] == [], k
        assert scan(" ".join(words[:k] + words[k + 1 :]))[3] == [], k
    assert scan(" ".join(words[:-1]))[3] == []


def test_parts_and_longer_licences():
    scan = lic.Scanner().scan
    text = {k: filled(t) for k, t in lic.TEMPLATES.items()}
    for k in ("isc", "bsd-2-clause", "bsd-3-clause", "unlicense", "mit"):
        whole = text[f"template:{k}"]
        assert scan(whole)[3] == [f"template:{k}"]
        half = " ".join(whole.split()[: len(whole.split()) // 2])
        assert scan(half + " " + prose(1, 80))[3] == []
    names = "THE COPYRIGHT HOLDERS AND CONTRIBUTORS"
    real = lic.TEMPLATES["template:bsd-3-clause"].replace("{12} as is", names + ' "AS IS"').replace("shall {12}", "shall the copyright holder or contributors")
    assert scan(real.replace("[[", "").replace("]]", ".").replace("{12}", "the copyright holder"))[3] == ["template:bsd-3-clause"]


def test_whole_notices():
    scan = lic.Scanner().scan
    apache = (
        'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\n'
        "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed "
        'to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License."
    )
    assert scan(apache)[3] == ["template:apache-2.0", "template:apache-2.0-notice"]
    gpl = (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    )
    assert scan(gpl)[3] == [] and scan(gpl + "See the GNU General Public License for more details.")[3] == ["template:gpl-program"]


def test_query_and_its_sql(spark, tmp_path):
    import duckdb

    from martloom.llm import queries

    texts = [filled(t) for t in lic.TEMPLATES.values()] + [" ".join(filled(t).split()[:-1]) for t in lic.TEMPLATES.values()]
    rows = [(k, prose(k, 20) + ". " + t.upper() + ". " + prose(k, 9)) for k, t in enumerate(texts)] + [(900, None), (901, ""), (901, "")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    duckdb.sql(f"create or replace view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.QUERIES["op8_license_templates"](spark, str(tmp_path))
    sql = duckdb.sql(queries.ORACLES["op8_license_templates"])
    assert got.columns == sql.columns and sorted(map(tuple, got.collect()), key=str) == sorted(sql.fetchall(), key=str)


def test_notices_of_the_base_phrases():
    scan = lic.Scanner().scan
    assert scan("Released under the MIT License.") == (5, [3], ["mit"], ["template:mit-notice"])
    assert scan("Licensed under the Apache License, Version 2.0.")[2:] == (["apache"], ["template:apache-2.0"])
    assert scan("This work is licensed under the GNU General Public License, version 3.")[2:] == (["gpl"], ["template:gpl-notice"])
    assert scan("Licensed under CC BY-NC 4.0.")[2:] == (["cc-by"], ["template:cc-by-notice"])
    assert scan("mit license MIT-License cc by")[:3] == (6, [0, 2, 4], ["cc-by", "mit"])


def test_bad_markup():
    for template in ("a ]] b", "a [[ b"):
        with pytest.raises(ValueError):
            lic.Automaton(template)
    with pytest.raises(ValueError):
        lic.anchored("[[a]] {3}")


def test_edges_and_clashing_columns(spark):
    found = {r.doc_id: r for r in lic.scan(clashing(documents(spark, edge_rows()), "starts", "n_words")).collect()}
    assert found[1].n_words == found[2].n_words == 0 and found[4].n_words == 30_000 and found[4].starts == []
    assert lic.scan(documents(spark, [])).collect() == []
