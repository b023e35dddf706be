import os
import random
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from edge_cases import LONG, ROWS, documents, prose  # noqa: E402

from corpusflow.llm import decontaminate, license_scan, license_texts  # noqa: E402


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


ITEMS = [
    (1, " ".join(LONG.split()[500:540])),
    (2, " ".join(LONG.split()[507:520]).upper()),
    (3, "one two"),
    (4, None),
    (5, ""),
    (6, "no words in common at all with any document of this table"),
    (None, "Été ñandú 日本語"),
    (1, prose(12, random.Random(9))),
    (10, "same same same same same same same same same same same same same"),
    (11, "all the same"),
]


def brute(rows, items):
    out = []
    for doc_id, text, *_ in rows:
        held = words(text)
        hit, found = set(), set()
        for item_id, item in items:
            w = words(item)
            k = min(10, len(w))
            for s in range(len(w) - k + 1 if w else 0):
                for p in range(len(held) - k + 1):
                    if held[p : p + k] == w[s : s + k]:
                        hit |= set(range(p, p + k))
                        found |= {str(item_id)} - {"None"}
        out.append((doc_id, len(held), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_decontamination_against_brute_force(spark, broadcast):
    extra = [(40, "x " + prose(12, random.Random(9)) + " y " + "same " * 15, "", 0, ""), (41, "same " * 12, "", 0, ""), (42, "été Ñandú 日本語", "", 0, "")]
    rows = [r for r in ROWS if r[1] != LONG] + [(50, " ".join(LONG.split()[480:600]), "", 0, ""), *extra]
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.scan(documents(spark, rows), benchmark, broadcast).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found), key=key) == sorted(brute(rows, ITEMS), key=key)


def test_clean_drops_hit_documents_and_keeps_the_columns(spark):
    docs = documents(spark)
    kept = decontaminate.clean(docs, spark.createDataFrame(ITEMS[:3], "item_id long, text string"))
    assert kept.schema == docs.schema
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, kept.collect()), key=key) == sorted((r for r in ROWS if r[0] not in (8, 9, 10, 11)), key=key)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(docs, empty).count() == len(ROWS)
    assert decontaminate.clean(documents(spark, []), empty).count() == 0


def brute_licenses(rows, notices):
    out = {}
    for doc_id, text, *_ in rows:
        held = words(text)
        for at, (name, notice) in enumerate(notices):
            w = words(notice)
            wanted = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
            stride = max(1, len(w) // 4)
            for start in range(0, len(held), stride):
                part = held[start : start + len(w) + stride]
                share = len(wanted & {tuple(part[j : j + 5]) for j in range(len(part) - 4)}) / len(wanted)
                if share >= 0.8:
                    before = out.get((doc_id, at, name), (0.0, start))
                    out[doc_id, at, name] = (max(share, before[0]), before[1])
    return sorted((*k, *v) for k, v in out.items())


def test_licenses_against_brute_force(spark):
    draw = random.Random(4)
    rows = [r for r in ROWS if r[0] is not None and r[0] not in (11, 12)]
    for i, (_, notice) in enumerate(license_scan.NOTICES * 2):
        lead, tail = prose(draw.randrange(0, 40), draw), prose(draw.randrange(0, 40), draw)
        cut = notice if i < len(license_scan.NOTICES) else " ".join(notice.split()[: -draw.randrange(1, 4)])
        rows.append((200 + i, f"{lead}\n{cut.upper() if i % 2 else cut}\n{tail}", "", 0, ""))
    rows.append((300, license_scan.NOTICES[2][1] + " " + license_scan.NOTICES[4][1] * 2, "", 0, ""))
    found = license_scan.scan(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.template, r.license, r.containment, r.start) for r in found) == brute_licenses(rows, license_scan.NOTICES)
    assert license_scan.scan(documents(spark, [])).count() == 0


def test_scans_run_no_python_on_executors(spark):
    docs, items = documents(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    for df in (decontaminate.scan(docs, items), license_scan.scan(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_licences_are_told_apart(spark):
    header = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    texts = {name: text for name, text, _ in license_texts.texts() if len(text) > 1200}
    cases = [
        (header.format("Lesser General Public License", "3"), {"LGPL-3.0"}),
        (header.format("Affero General Public License", "3"), {"AGPL-3.0"}),
        (header.format("General Public License", "2"), {"GPL-2.0"}),
        (header.format("General Public License", "3"), {"GPL-3.0"}),
        (header.format("Curious General Public License", "3"), set()),
        ("This work is licensed under the GNU General Public License, version 2.", {"GPL-2.0"}),
        ("This work is licensed under the GNU General Public License, version 7.", set()),
        (license_scan.NOTICES[5][1], {"MIT"}),
        *[(text, {name}) for name, text in texts.items()],
    ]
    docs = documents(spark, [(i, f"{prose(7)} {text} {prose(9)}", "", 0, "") for i, (text, _) in enumerate(cases)])
    found = {i: set() for i in range(len(cases))}
    for r in license_scan.identify(docs).collect():
        found[r.doc_id].add(r.license)
    assert [found[i] for i in range(len(cases))] == [names for _, names in cases]


def brute_identify(rows, templates):
    """Windows, phrases and the choice among overlapping licences over plain lists of words."""
    out = []
    made = []
    for i, (name, text, telling) in enumerate(templates):
        w = license_scan.template_words(text)
        made.append((i, name, len(w), max(1, len(w) // 4), {" ".join(w[j : j + 5]) for j in range(len(w) - 4)}, [f" {' '.join(license_scan.template_words(x))} " for x in telling]))
    for doc_id, text in sorted({(r[0], r[1] or "") for r in rows}, key=repr):
        words = license_scan.template_words(text)
        grams = [" ".join(words[j : j + 5]) for j in range(len(words) - 4)]
        windows = []
        for i, name, n, s, shingles, phrases in made:
            at = [p for p, g in enumerate(grams) if g in shingles]
            starts = {k * s for p in at for k in range(max(0, -(-(p - (n + s - 5)) // s)), p // s + 1)}
            for start in starts:
                inside = [p for p in at if start <= p <= start + n + s - 5]
                held = {grams[p] for p in inside}
                if len(held) / len(shingles) >= 0.8:
                    told = all(any(x in f" {g} " for g in held) for x in phrases)
                    windows.append((i, name, start, len(held), len(held) / len(shingles), told, frozenset(inside)))
        best, heard = {}, {}
        for i, name, start, n_held, share, told, inside in windows:
            for p in inside:
                if told:
                    best[p] = max(best.get(p, (0,)), (n_held, share, -i, name))
                    heard.setdefault((i, p), True)
        found = {}
        for i, name, start, n_held, share, told, inside in windows:
            if any(heard.get((i, p)) for p in inside) and not any(best[p][3] != name for p in inside if p in best):
                old = found.get((i, name), (0.0, start))
                found[i, name] = (max(old[0], share), min(old[1], start))
        out += [(doc_id, i, name, round(share, 9), start) for (i, name), (share, start) in found.items()]
    return sorted(out)


def test_identify_against_brute_force_with_all_templates(spark):
    """Every template whole, in prose, and with a fifth of its words changed."""
    draw = random.Random(12)
    rows = []
    for i, (_, text, _) in enumerate(license_scan.TEMPLATES):
        rows.append((i, f"{prose(9, draw)}. {text} {prose(7, draw)}", "", 0, ""))
        w = text.split()
        for k in range(3, len(w), 31):
            w[k] = "changed"
        rows.append((1_000 + i, " ".join(w), "", 0, ""))
    found = license_scan.identify(documents(spark, rows)).collect()
    want = brute_identify(rows, license_scan.TEMPLATES)
    assert sorted((r.doc_id, r.template, r.license, round(r.containment, 9), r.start) for r in found) == want
    named = {}
    for r in found:
        named.setdefault(r.doc_id, set()).add(r.license)
    for i, (name, text, _) in enumerate(license_scan.TEMPLATES):
        if len(text) > 700:
            assert named[i] == {name}, (name, named[i])


def test_a_text_that_only_changed_its_name_has_no_or_its_own_licence(spark):
    whole = {name: text for name, text, _ in license_texts.texts() if len(text) > 700}
    swap = lambda text, old, new: re.sub(r"(?i)" + old.replace(" ", r"\s+"), new, text)
    cases = [
        (swap(whole["GPL-3.0"], "GNU General Public License", "GNU Affero General Public License"), {"AGPL-3.0"}),
        (swap(whole["GPL-2.0"], "GNU General Public License", "Acme Private Licence"), set()),
        (swap(whole["GPL-2.0"], "Version 2", "Version 9"), {"GPL"}),  # its appendix still names the licence, without a version
        (swap(whole["Apache-2.0"], "Apache License", "Acme License"), set()),
        (swap(whole["MPL-2.0"], "Mozilla Public License", "Acme Public License"), set()),
        (swap(whole["GFDL-1.2"], "Version 1.2", "Version 1.7"), set()),
        (whole["BSD-4-Clause"], {"BSD-4-Clause"}),
        (whole["BSD-3-Clause"], {"BSD-3-Clause"}),
        (whole["BSD-2-Clause"], {"BSD-2-Clause"}),
        (whole["MIT-0"], {"MIT-0"}),
        (whole["MIT"], {"MIT"}),
        (whole["Zlib"], {"Zlib"}),
        (whole["Unlicense"], {"Unlicense"}),
    ]
    docs = documents(spark, [(i, text, "", 0, "") for i, (text, _) in enumerate(cases)])
    found = {i: set() for i in range(len(cases))}
    for r in license_scan.identify(docs).collect():
        found[r.doc_id].add(r.license)
    assert found == {i: names for i, (_, names) in enumerate(cases)}


def test_bands_point_to_templates_with_a_fifth_of_their_shingles_changed(spark):
    """Copies at every offset to the windows, with words changed at random places."""
    draw = random.Random(3)
    rows, want = [], {}
    for i, (_, text, _) in enumerate(license_scan.TEMPLATES):
        w = license_scan.template_words(text)
        if len(w) >= license_scan.WINDOW + license_scan.STRIDE + 4:
            for offset in range(0, 16, 3):
                copy = list(w)
                for k in draw.sample(range(len(w)), max(1, len(w) // 25)):  # five shingles hold a word
                    copy[k] = "changed"
                rows.append((len(rows), " ".join(license_scan.template_words(prose(offset + 1, draw)) + copy), "", 0, ""))
                want[len(rows) - 1] = i
    docs = documents(spark, rows)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key")).join(license_scan.candidates(docs, license_scan.TEMPLATES), "text_key")
    may = {r.doc_id: set(r.may) for r in keyed.collect()}
    assert all(want[i] in may.get(i, ()) for i in want) and len(want) > 60


def test_candidates_beyond_the_broadcast_bound_give_the_same(spark, monkeypatch):
    rows = [(i, n[1] + " " + prose(5), "", 0, "") for i, n in enumerate(license_scan.NOTICES * 3)]
    before = sorted(map(tuple, license_scan.identify(documents(spark, rows)).collect()))
    monkeypatch.setattr(license_scan, "BROADCAST_ROWS", 3)
    assert sorted(map(tuple, license_scan.identify(documents(spark, rows)).collect())) == before and before
