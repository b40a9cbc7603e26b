"""Cases that bounds used to leave out."""

import random
import re

from strandspark.llm import licenses, pii, toxicity


def scan(spark, values):
    rows = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    return {r.doc_id: r for r in licenses.license_scan(rows).collect()}


def test_licence_in_a_long_sentence(spark):
    run = "and so on it goes " * 300
    got = scan(spark, [f"{run}released under the MIT License", f"{run}licensed under CC BY-SA 4.0 {run}", f"{run}some licence {run}", "-" * 200_000 + " licence " + "under " * 20_000 + "x"])
    assert [got[i].licenses for i in range(4)] == ["MIT", "CC-BY-SA-4.0", "", ""] and got[2].n_unknown == 1 and got[3].n_unknown == 1


def test_licence_patterns_tried_once_fit_the_same(spark):
    """Rules with a gap take the first place of their opening; that finds what trying all places finds."""
    rng = random.Random(3)
    bits = ["in no event shall ", "in no event will ", " be liable ", "redistribution and use in source and binary forms", "are permitted ", "license ", "x ", "permission to use, copy, modify, and distribute this software for any purpose ", "appear in all copies "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 8))) + " license" for _ in range(300)]
    plain = lambda t: re.sub(r"^[ .,/*-]+|[ .,/-]+$", "", re.sub(r"[^a-z0-9.,/+-]+", " ", t.lower()))
    want = [next((n for n, p in licenses.SENTENCES if re.search(p, plain(t))), "Unknown") for t in texts]
    got = scan(spark, texts)
    assert [got[i].sequence for i in range(len(texts))] == want and len(set(want)) > 4


def test_misspelled_stems():
    t = toxicity.Trie([], ["idiot"])
    assert all(toxicity.intersect(t, w) == ["idiot"] for w in ("idot", "idotic", "idi0ts", "idiiotic", "idiod"))
    assert all(toxicity.intersect(t, w) == [] for w in ("idiosyncratic", "idol", "riot"))
    m = toxicity.Model(["moron"], ["idiot", "scum"]).matcher()
    assert {w: m.kind(w) for w in ("idiotic", "idot", "idotic", "idi0ts", "1diot", "1diots", "m0ron", "0oron", "idiosyncratic", "riot", "moronic")} == {
        "idiotic": 1, "idot": 2, "idotic": 2, "idi0ts": 2, "1diot": 2, "1diots": 2, "m0ron": 2, "0oron": 2, "idiosyncratic": 0, "riot": 0, "moronic": 0,
    }


def test_quick_looks_for_stems_lose_nothing():
    rng = random.Random(5)
    stem = "stupid"
    m = toxicity.Model([], [stem]).matcher()
    for _ in range(500):
        i, c = rng.randrange(1, len(stem)), rng.choice("abz0")
        w = rng.choice([stem[:i] + stem[i + 1 :], stem[:i] + c + stem[i:], stem[:i] + c + stem[i + 1 :]]) + rng.choice(["", "ity", "s"])
        assert m.kind(w) == (1 if w.startswith(stem) else 2 if toxicity.intersect(m.trie, w) else 0)


def test_long_secret_is_one_span(spark):
    value = "aB3" * 200
    df = spark.createDataFrame([(1, f"see token={value} end")], "doc_id long, text string")
    (s,) = pii.pii_spans(df).first().spans
    assert (s["start"], s["end"]) == (4, 10 + len(value)) and pii.redact(df).first().text == "see [secret] end"


def test_usual_wording_of_licences(spark):
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version."
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this.\n"
    got = scan(spark, ["# SPDX-License-Identifier: MIT\nimport os", "/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR Apache-2.0 */", gpl, grant + 'It is provided "AS IS", WITHOUT WARRANTY of any kind.'])
    assert [got[i].licenses for i in range(4)] == ["MIT", "GPL-2.0-only,Apache-2.0", "GPL-2.0-or-later", "MIT"] and got[0].n_unknown == 0
    assert got[3].sequence == "MitGrant,AsIs"


def test_licences_within_sentences(spark):
    """What stands before and after a known sentence, versions, and notices without the word licence."""
    lgpl = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice.\n2. Redistributions in binary form must reproduce the above copyright notice.\n"
    name = "3. Neither the name of the copyright holder may be used to endorse or promote products derived from this software without specific prior written permission."
    zlib = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages. Permission is granted to anyone to use this software for any purpose. The origin of this software must not be misrepresented."
    cases = [
        ("licensed under the Apache License, Version 2.0 and nothing else", "Apache-2.0"), ("Released under the MIT license word word", "MIT"), ("All of it is under CC BY 3.0 terms", "CC-BY-3.0"), ("Shared under CC BY-NC-SA.", "CC-BY-NC-SA"),
        ("All rights reserved by the author", "Proprietary"), ("Code under GPLv3 or later", "GPL-3.0-or-later"), (lgpl, "LGPL-2.1-or-later"), ("under the terms of the GNU General Public License.", "GPL"), (isc, "ISC"), (isc.partition(", provided")[0] + ".", "0BSD"),
        (bsd, "BSD-2-Clause"), (bsd + name, "BSD-3-Clause"), (zlib, "Zlib"), ("This is in the public domain.", "Public-Domain"), ("under the Mozilla Public License, v. 2.0", "MPL-2.0"), ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
        ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", "GPL"), ("The MIT License (MIT)", "MIT"), ("BSD 3-Clause License", "BSD-3-Clause"), ("It is under the CC0.", "CC0-1.0"), ("She has a driving licence", ""),
    ]
    got = scan(spark, [t for t, _ in cases])
    assert [got[i].licenses for i in range(len(cases))] == [n for _, n in cases]
