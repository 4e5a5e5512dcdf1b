import re

from panelcast.llm import license_scan as ls

from .conftest import LONG

ROWS = [
    (1, "Released under the MIT License.\nBody"), (2, "Licensed under CC BY-NC 4.0. All Rights Reserved."),
    (3, "This work is licensed under the GNU General Public License, version 3."), (4, None), (5, ""),
    (6, "all rights all rights reserved reserved"), (7, "Licensed under the Apache License, Version 2.0"),
    (8, "the mit and the license are far apart"), (None, "cc by cc by"), (2, "cc-by"), (9, LONG + " Mit License"),
    (10, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
         "documentation files, to deal in the Software without restriction"),
    (11, "élan 漢字 CCÉ by"), (12, "gnu general public license version 2 and gnu general public license version 3"),
]


def base(text):
    words = re.findall(ls.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for p, label in ls.BASE.items() for i in range(len(words))
             if words[i:i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return (len(words), len(found), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for _, x in found})))


def test_base_places_and_labels(make_docs):
    got = ls.scan_licenses(make_docs(ROWS)).collect()
    assert len(got) == len(ROWS)
    assert (sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in got)
            == sorted((str(i), b[0], b[1], str(b[2]), str(b[3]), b[4]) for i, b in ((i, base(t)) for i, t in ROWS)))
    labels = {r.doc_id: r.labels for r in got if r.doc_id not in (None, 2)}
    assert labels[1] == labels[10] == labels[9] == "mit"
    assert labels[3] == "gpl,gpl-3.0" and labels[7] == "apache-2.0" and labels[12] == "gpl,gpl-2.0,gpl-3.0"
    assert labels[4] == labels[5] == labels[8] == labels[11] == "" and labels[6] == "reserved"
    assert {r.labels for r in got if r.doc_id == 2} == {"cc-by,cc-by-nc-4.0,reserved", "cc-by"}
    score = {r.doc_id: r.score for r in got}
    assert score[1] == 1.0 and score[6] == 0.5 and score[8] == 0.0 and all(0 <= r.score <= 1 for r in got)


def test_fewer_lookups_lose_nothing(make_docs):
    files = ls.cut_lineage(ls.read_files(make_docs(ROWS)), "files")
    every = {(r._row, r.label) for r in ls.find_licenses(files).collect()}
    few = {(r._row, r.label) for r in ls.find_licenses(files, rare_words=1).collect()}
    assert few == every and few


def test_empty_table(make_docs):
    assert ls.scan_licenses(make_docs(ROWS).limit(0)).count() == 0


def notice():
    """One file that holds every template, and files that make some of its words common."""
    every = "\n\n".join(f"Part {i}.\n{text}." for i, (_, text, _) in enumerate(ls.TEMPLATES))
    common = ["licensed under apache license version", "released under mit license", "gnu general public terms"] * 20
    return [(1, every), *((100 + i, t) for i, t in enumerate(common))]


def test_a_file_with_all_templates(make_docs):
    labels = {label for label, _, _ in ls.TEMPLATES}
    files = ls.cut_lineage(ls.read_files(make_docs(notice())), "files")
    row = files.where("_id = 1").first()._row
    found = [r for r in ls.find_licenses(files).collect() if r._row == row]
    assert {r.label for r in found} == labels and len(found) == len(ls.TEMPLATES)
    assert {r.score for r in found} == {1.0}
    alone = ls.cut_lineage(ls.read_files(make_docs(notice()[:1])), "files")  # other files change nothing
    assert sorted(r[1:] for r in ls.find_licenses(alone).collect()) == sorted(r[1:] for r in found)
    row = {r.doc_id: r for r in ls.scan_licenses(make_docs(notice())).collect()}[1]
    assert set(row.labels.split(",")) == labels | set(ls.BASE.values()) - {"reserved"} and row.score == 1.0


def test_a_file_with_all_templates_as_the_sql_twin_has_it(make_docs):
    import duckdb

    from panelcast.llm.sql import OP4
    con, docs = duckdb.connect(), make_docs(notice())
    documents = docs.select("doc_id", "text").toArrow()
    con.register("documents", documents)
    want = con.sql(OP4)
    got = ls.scan_licenses(docs).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


def test_any_number_of_lookups_gives_one_answer(make_docs):
    """Which words are looked up saves work; a file with all templates, and many with one common word."""
    every = "\n".join(t for _, t, _ in ls.TEMPLATES)
    rows = [every, every.upper(), every[:400]] + [f"the license of the software {i}" for i in range(30)]
    rows += [t for _, t, _ in ls.TEMPLATES] + [" ".join(reversed(every.split())), None, ""]
    got = [sorted(map(str, ls.scan_licenses(make_docs(rows), rare_words=n).collect())) for n in (1, 2, 5, 50)]
    assert got[0] == got[1] == got[2] == got[3]
    labels = {r.doc_id: r.labels for r in ls.scan_licenses(make_docs(rows)).collect()}
    assert set(labels[0].split(",")) >= {label for label, _, _ in ls.TEMPLATES}
    for i, (label, _, _) in enumerate(ls.TEMPLATES):
        assert label in labels[33 + i].split(",")


def test_the_rarest_mandatory_words_are_looked_up(make_docs):
    rows = ["apache license version 2 0"] * 3 + ["license version"] * 20 + ["version"] * 5
    files = ls.read_files(make_docs(rows)).cache()
    found = ls.lookups(files, 1).where("tid = 0").collect()
    assert [(r.word, r.need) for r in found] == [("0", 1)]  # held by as few files as apache and 2
