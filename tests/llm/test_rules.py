import random
import re

import pytest

from tools.check import compare
from vigilog.llm import decontamination, licences, quality
from vigilog.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, con, sf, name):
    _, verdict = compare(spark, con, name, QUERIES[name], SQL[name], sf)
    assert verdict.startswith("ok"), verdict


def test_base_counts(edges, nothing):
    def counts(text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        seen = {}
        for t in triples:
            seen[t] = seen.get(t, 0) + 1
        covered = {i + d for i, t in enumerate(triples) if seen[t] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)

    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(edges).collect()), key=str)
    assert got == sorted(((r.doc_id, *counts(r.text)) for r in edges.collect()), key=str)
    assert quality.quality(nothing).count() == 0 and quality.filtered(nothing).count() == 0


def test_divergent_texts_are_rejected_and_prose_stays(spark, docs):
    prose = [r.text for r in docs.where("lang = 'en' AND n_chars > 2000").limit(3).collect()]
    symbols = " ".join(w + s for w, s in zip(prose[0].split(), ["###", "&&&", "$$$", "%%%"] * 5_000))
    capitals = " ".join(w.upper() + "!!" for w in prose[0].split())
    more = spark.createDataFrame([(-1, symbols, "en"), (-2, capitals, "en"), *((-3 - i, t, None) for i, t in enumerate(prose))], "doc_id long, text string, lang string")
    kept = {r.doc_id: (r.kept, r.base_failed) for r in quality.quality(docs.select("doc_id", "text", "lang").unionByName(more)).where("doc_id < 0").collect()}
    assert not kept[-1][0] and not kept[-2][0]
    assert all(kept[i][0] or kept[i][1] for i in (-3, -4, -5))
    columns = docs.limit(30)
    assert quality.filtered(columns).columns == columns.columns


def test_leaks_and_clean_texts(spark, edges, nothing):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "two words"), (1, item), (None, "lonely words of an item without number")], "item_id long, text string")
    rows = [
        (10, f"Before it. {item.upper()}! And after it."), (11, item[: len(item) // 2]), (12, "so two, words here"), (13, None),
        (14, item.replace("alpha ", "first ")), (None, item), (15, "lonely words of an item without number"), (16, item + " " + item),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontamination.leaks(docs, bench)
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got == {(10, 1), (12, 4), (14, 1), (None, 1), (15, None), (16, 1)}
    kept = decontamination.decontaminated(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [11, 13]
    assert decontamination.leaks(edges, bench.limit(0)).count() == 0 and decontamination.leaks(nothing, bench).count() == 0
    same = decontamination.decontaminated(edges, bench)
    assert same.columns == edges.columns and same.count() == edges.count()


def test_leaks_at_every_window_start(spark):
    def parts(words):
        return [" ".join(words[i : i + 5]) for i in range(len(words) - 4)]

    def similarity(one, other):
        shared = sum(min(one.count(x), other.count(x)) for x in set(one))
        return shared / (len(one) + len(other) - shared)

    item = [f"w{i}" for i in range(60)]
    other = [f"v{i % 17}" for i in range(44)]
    before, after = [f"b{i}" for i in range(100)], [f"a{i}" for i in range(100)]
    pieces = [item[30:] + item[:30], item[20:40] + item[:20] + item[40:], item[35:] + item[:30], item[:50] + before[:10], other[22:] + other[:22], item[40:]]
    texts = [w for p in pieces for w in (before + p + after, p, before + p, p + after)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other))], "item_id long, text string")
    want = {}
    for i, words in enumerate(texts):
        for j, x in ((1, item), (2, other)):
            best = max(similarity(parts(words[s : s + len(x)]), parts(x)) for s in range(max(0, len(words) - len(x)) + 1))
            if best >= 0.8:
                want[i, j] = round(best, 9)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontamination.leaks(docs, bench).collect()} == want
    assert (0, 1) in want


def test_windows_are_found_once_a_text_and_candidates_are_names(spark):
    item, again = " ".join(f"w{i}" for i in range(30)), "one two three four five six " * 6
    bench = spark.createDataFrame([(1, item), (2, item), (3, again), (3, item + " end")], "item_id long, text string")
    docs = spark.createDataFrame([(i % 40, t) for i in range(80) for t in (f"so {item} it ends", again + "seven")], "doc_id long, text string")
    items = decontamination.item_table(bench)
    found = decontamination.windows(docs, items)
    assert found.count() == decontamination.windows(docs.limit(2), items).count() == found.select("text_key", "n_words", "start").distinct().count()
    pairs = decontamination.candidates(found, items)
    assert pairs.count() and all(kind in ("string", "int") for _, kind in pairs.dtypes)
    got = sorted((r.doc_id, r.item_id, round(r.similarity, 6)) for r in decontamination.leaks(docs, bench).collect())
    best = round(26 / 28, 6)  # the item with one word more
    assert got == sorted((i, *x) for i in range(40) for x in ((1, 1.0), (2, 1.0), (3, best), (3, 1.0)))


def test_blocks_of_the_benchmark_change_nothing(docs, spark, sf, monkeypatch):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = set(map(tuple, decontamination.leaks(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_SHINGLES", 40)
    assert whole and whole == set(map(tuple, decontamination.leaks(docs, bench).collect()))


def test_licence_sentences(edges, nothing):
    text = (
        "Intro.\nCopyright (c) 2020 Somebody. All rights reserved.\nLicensed under the Apache License, Version 2.0 (the \"License\");\n"
        "you may not use this file except\nin compliance with the License. Released under the MIT\nLicense. It is released under the MIT License."
    )
    names = [n for _, _, n in licences.known_sentences(text)]
    assert names == ["copyright", "reserved", "apache-head", "apache-may-not", "mit-short", "mit-short"]
    assert licences.licences(names) == ["all-rights-reserved", "Apache-2.0", "MIT", "MIT"]
    got = licences.licence_scan(edges).collect()
    assert len(got) == edges.count() and all(r.n_sentences == 0 and r.licences == "" for r in got)
    assert licences.licence_scan(nothing).count() == 0


def test_licences_in_prose_headers_and_spdx_lines():
    bsd = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
    1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
       documentation and/or other materials provided with the distribution.\n"""
    names = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
    free = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    for text, want in (
        ("This project is licensed under the MIT License.", ["MIT"]), ("This software is licensed under the MIT License - see LICENSE for more", ["MIT"]),
        ("This code is not licensed under the MIT License.", []), ("The code is released under the Apache License, Version 2.0.", ["Apache-2.0"]),
        ("// SPDX-License-Identifier: MIT", ["MIT"]), ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-2-Clause */", ["GPL-2.0-only", "BSD-2-Clause"]),
        (free.format("program", "General Public License", "2"), ["GPL-2.0-or-later"]), (free.format("library", "Lesser General Public License", "2.1"), ["LGPL-2.1-or-later"]),
        (free.format("program", "Affero General Public License", "3"), ["AGPL-3.0-or-later"]), ("The program is distributed under the GNU GPL v3 or later, as it was.", ["GPL-3.0-or-later"]),
        (bsd, ["BSD-2-Clause"]), (bsd + names, ["BSD-3-Clause"]),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ["ISC"]),
    ):
        assert licences.licences([n for _, _, n in licences.known_sentences(text)]) == want, text


def test_grants_at_any_word():
    for text, want in (
        ("It is released under the MIT License.", ["MIT"]), ("The code in this repository is released under the MIT license.", ["MIT"]),
        ("Licensed under the Eclipse Public License 2.0.", ["EPL-2.0"]), ("Dual-licensed under MIT or Apache-2.0", ["MIT", "Apache-2.0"]),
        ("It needs a tool which is licensed under the GPL v3.", ["GPL-3.0-only"]), ("It is dual licensed under either the MIT license or the Boost Software License 1.0, too", ["MIT", "BSL-1.0"]),
        ("It was never released under the MIT license.", []), ("licensed under MIT press rules", []), ("licensed under MIT", ["MIT"]), ("released under licence", []),
    ):
        assert licences.licences([n for _, _, n in licences.known_sentences(text)]) == want, text


def slow_sentences(text):
    """Every table entry tried at every word."""
    places = list(re.finditer(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*", text))
    words = [w[0].lower() for w in places]
    ends = [i + 1 == len(words) or bool(re.search(r"[.!?;:\n]", text[places[i].end() : places[i + 1].start()])) for i in range(len(words))]
    grants = [f"{g} under{t}".split() for g in licences.GRANTS for t in ("", " the", " a", " either", " either the")]

    def longest(table, at, whole):
        fits = [(at + len(x.split()), k) for k, xs in table.items() for x in xs if words[at : at + len(x.split())] == x.split()]
        return max((f for f in fits if not whole or ends[f[0] - 1]), key=lambda f: f[0], default=(0, ""))

    def name(at):
        found, bare = longest(licences.NAMES, at, False), longest(licences.BARE, at, False)
        return found if found[0] else bare if bare[0] and (ends[bare[0] - 1] or words[bare[0]] in ("or", "and")) else (0, "")

    out, at = [], 0
    while at < len(words):
        sentence = longest(licences.SENTENCES, at, True) if not at or ends[at - 1] else (0, "")
        opened = max((at + len(g) for g in grants if words[at : at + len(g)] == g), default=0)
        if sentence[0]:
            out.append(sentence[1])
            at = sentence[0]
            continue
        end = at
        if opened and not set(words[max(0, at - 3) : at]) & licences._NOT:
            here = opened
            while here < len(words) and name(here)[0]:
                end, found = name(here)
                out.append(found)
                if end == len(words) or words[end] not in ("or", "and") or ends[end - 1]:
                    break
                here = end + 1 + (words[end + 1 : end + 2] in (["the"], ["a"]))
        at = max(end, at + 1)
    return out


def test_sentences_against_brute_force():
    rng = random.Random(4)
    known = [x for table in (licences.SENTENCES, licences.NAMES, licences.BARE) for xs in table.values() for x in xs]
    words = ["licensed", "under", "the", "mit", "released", "not", "or", "and", "a", "dual-licensed", "license", "gpl", "v3", "either", "apache-2.0"]
    for _ in range(1500):
        parts = [rng.choice([rng.choice(known), f"{rng.choice(licences.GRANTS)} under {rng.choice(['the ', '', 'a '])}{rng.choice(known)}", rng.choice(words)]) for _ in range(rng.randrange(1, 8))]
        text = "".join(p + rng.choice([" ", " ", ". ", "\n", ", "]) for p in parts)
        assert [n for _, _, n in licences.known_sentences(text) if n != "copyright"] == slow_sentences(text), text


def test_licences_of_the_documents(docs, con):
    got = {(r.doc_id, x) for r in licences.licence_scan(docs).collect() for x in r.licences.split(",") if x}
    lines = {
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", "All rights reserved.": "all-rights-reserved",
    }
    want = {(r.doc_id, lines[x]) for r in docs.collect() for x in (r.text or "").split("\n") if x in lines}
    assert got == want and want
