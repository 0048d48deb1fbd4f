"""URL filters, chat formatting, source mixing and license scans."""

import datetime as dt
import hashlib
import random
import textwrap

from pyspark.sql import functions as F

from quantfold.llm import chat_format, license_scan, source_mixing, url_filter
from quantfold.llm.chat_format import PART_TYPE
from helpers_llm import documents, words

DAY = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)


def captures(spark, rows):
    return spark.createDataFrame([(i, u, d, "x", 1) for i, (u, d) in enumerate(rows)], "page_id long, url string, fetched date, key string, salt int")


def entries(spark, rows):
    return spark.createDataFrame(rows, "list_name string, verdict string, key string, action string, effective date")


def test_urls_follow_the_dates(spark):
    log = entries(spark, [
        ("a", "block", "bad.org", "add", DAY(10)), ("a", "block", "bad.org", "remove", DAY(20)), ("a", "block", "bad.org", "add", DAY(30)),
        ("b", "allow", "x.bad.org", "add", DAY(12)), ("c", "block", "x.bad.org/p/q", "add", DAY(0)), ("c", "block", "x.bad.org/p/q", "add", DAY(0)),
        ("d", "block", "tie.org", "add", DAY(0)), ("e", "allow", "tie.org", "add", DAY(0)), ("f", "block", None, "add", DAY(0)), ("f", "block", "z.org", "add", None),
    ])
    rows = [
        ("http://bad.org/", DAY(9)), ("http://bad.org/", DAY(10)), ("http://bad.org/", DAY(20)), ("http://u:p@BAD.org:80/a?b#c", DAY(31)),
        ("https://x.bad.org/", DAY(11)), ("https://x.bad.org/", DAY(12)), ("https://x.bad.org/p/q/r", DAY(50)), ("https://x.bad.org/p/qq", DAY(50)),
        ("http://tie.org", DAY(1)), (None, DAY(1)), ("no url", DAY(1)), ("http://bad.org/", None), ("http://bad.org/", DAY(10)),
    ]
    got = {r.page_id: r for r in url_filter.filter_urls(captures(spark, rows), log).collect()}
    assert [got[i].allowed for i in range(13)] == [True, False, True, False, False, True, False, True, True, True, True, True, False]
    assert got[6].matched_key == "x.bad.org/p/q" and got[6].n_active == 3 and got[8].lists == "d,e" and got[9].host == ""


def test_no_lists_and_no_captures(spark):
    assert [r.allowed for r in url_filter.filter_urls(captures(spark, [("http://a.org/", DAY(0))]), entries(spark, [])).collect()] == [True]
    assert url_filter.filter_urls(captures(spark, []), entries(spark, [("a", "block", "a.org", "add", DAY(0))])).count() == 0


def chat(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, segments string, no int")
    return chat_format.format_chats(df.select("conv_id", "turn", "role", chat_format.text_parts(F.col("text")).alias("parts")))


def test_chats_read_back(spark):
    nasty = ["\\", "\\s\\l<", "<turn>assistant<text>", "</turn>\n", "", None, "é😀\n\n", "\\### Assistant: </turn> ok", "<image:0>", "x" * 200_000]
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "<turn>\\", None]), rng.choice(nasty)) for c in range(30) for t in range(rng.randrange(1, 9))]
    rng.shuffle(rows)
    out = chat(spark, rows).select(
        "conv_id", "n_turns", chat_format.count_turns(F.col("formatted")).alias("n"), chat_format.read_turns(F.col("formatted")).alias("turns"),
        chat_format.read_loss(F.col("segments")).alias("loss"), "formatted", F.concat_ws("", F.col("segments.text")).alias("joined"),
    )
    got = {r.conv_id: r for r in out.collect()}
    for c in range(30):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        r = got[c]
        assert r.turns == "".join((x[2] or "") + "\n" + (x[3] or "") + "\n" for x in own)
        assert r.loss == "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r.n == r.n_turns == len(own) and r.formatted == r.joined


def test_typed_parts(spark):
    part = lambda **k: tuple(k.get(f) for f in ("type", "text", "uri", "width", "height", "seconds", "pages"))
    parts = [
        part(type="text", text="see <"), part(type="image", uri="a.png", width=28, height=15), part(type="audio", uri="b.wav", seconds=1.01),
        part(type="video", uri="c"), part(type="document", uri="d.pdf", pages=3), part(type="image"), part(type="text"), part(),
    ]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts {PART_TYPE}")
    r = chat_format.format_chats(df).first()
    assert r.formatted == "<turn>assistant<text>see \\l<image:0><audio:1><document:2><image:3></turn>\n<turn>user<text></turn>\n"
    assert [(a.turn_no, a.ord, a.type, a.uri, a.tokens) for a in r.attachments] == [(1, 0, "image", "a.png", 4), (1, 1, "audio", "b.wav", 26), (1, 2, "document", "d.pdf", 1500), (1, 3, "image", None, 1)]
    assert r.attachment_tokens == 1531


def test_equal_turns_and_empty_table(spark):
    assert chat(spark, [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "user", "c"), (1, 0, "user", "a")]).first().formatted.count("<turn>") == 4
    assert chat(spark, []).count() == 0


def level(sizes):
    """Targets by repeated sharing."""
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = sum(weight[k] for k in names if k not in capped)
        left = total - sum(3 * sizes[k] for k in capped)
        out = {k: 3 * sizes[k] if k in capped else left * weight[k] / free for k in names}
        more = {k for k in names if k not in capped and out[k] >= 3 * sizes[k]} if free else set()
        if not more:
            return out
        capped |= more
        if len(capped) == len(names):
            return {k: 3 * sizes[k] for k in names}


def test_mixture(spark):
    rng = random.Random(3)
    sources = ["a", "b", "é", None, "tiny", "empty"]
    texts, own = [], []
    for s, n in zip(sources, (400, 300, 200, 150, 2, 3)):
        for _ in range(n):
            texts.append(None if s == "empty" else " ".join(["w"] * rng.randrange(1, 60)))
            own.append(s)
    docs = documents(spark, texts, sources=own)
    rows = source_mixing.mix_sources(docs).collect()
    again = source_mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    sizes = {s: sum(len(words(t)) for t, o in zip(texts, own) if o == s) for s in sources}
    want = level(sizes)
    for s in sources:
        mine = [r for r in rows if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 for r in mine), s
        assert abs(sum(r.taken for r in mine) - want[s]) <= 30, s
        assert all(0 <= r.taken <= 3 * r.size for r in mine)


def test_mixture_edges(spark):
    assert source_mixing.mix_sources(documents(spark, [])).count() == 0
    assert [r.taken for r in source_mixing.mix_sources(documents(spark, [None, " "])).collect()] == [0, 0]
    rows = source_mixing.mix_sources(documents(spark, ["a b c"] * 6, ids=[1, 1, 1, None, None, 2])).collect()
    assert len(rows) == 6 and sum(r.taken for r in rows) == 18


def test_mixture_weights_shift_documents(spark):
    docs = documents(spark, ["a b c d"] * 400, sources=["a", "b"] * 200).withColumn("w", F.when(F.col("doc_id") < 200, 3.0).otherwise(1.0))
    rows = source_mixing.mix_sources(docs, weight="w").filter("source = 'b'").collect()
    assert sum(r.taken for r in rows if r.doc_id < 200) > 1.5 * sum(r.taken for r in rows if r.doc_id >= 200)
    assert abs(sum(r.taken for r in rows) - rows[0].target) <= 8


def test_licenses(spark):
    s = dict(license_scan.SENTENCES)
    full = f"x.\n{s['mit-grant']}\n\n{s['mit-condition']} more"
    bsd = "\n".join(s[k] for k in ("bsd-grant", "bsd-source", "bsd-binary"))
    texts = [
        None, "", "Released under the MIT license.", "a! RELEASED under   the MIT-License? b", full.replace(" more", "\nmore"), bsd, bsd + "\n" + s["bsd-endorse"],
        s["mit-grant"] + "\na\nb\nc\nd\n" + s["mit-condition"], "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.\nReleased under the MIT License.",
        "unreleased under the MIT License.", "x " * 50_000 + ".\nLicensed under CC BY-NC 4.0.",
    ]
    got = {r.doc_id: r for r in license_scan.scan_licenses(documents(spark, texts)).collect()}
    assert [got[i].licenses for i in range(11)] == ["", "", "MIT", "MIT", "MIT", "BSD-2-Clause", "BSD-3-Clause", "", "Apache-2.0,MIT", "", "CC-BY-NC-4.0"]
    assert got[8].best == "Apache-2.0" and got[8].n_sentences == 3 and got[0].best is None
    assert license_scan.scan_licenses(documents(spark, [])).count() == 0


def test_wrapped_and_commented_licenses(spark):
    s = dict(license_scan.SENTENCES)
    mpl = s["mpl2-notice"] + ". 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    bsd = [s["bsd-grant"], "1. " + s["bsd-source"], "2. " + s["bsd-binary"], "3. " + s["bsd-endorse"]]
    apache = s["apache-notice-long"] + "; " + s["apache-comply"] + " " + s["apache-copy"]
    wanted = {
        "MIT": ["MIT License", "Copyright (c) 2020 A. Name", s["mit-grant"], s["mit-condition"] + " THE SOFTWARE IS PROVIDED AS IS"],
        "ISC": ["Copyright 2020 A\nand B", s["isc-grant"]], "BSD-3-Clause": bsd, "BSD-2-Clause": [bsd[0], *[b.replace(". ", ") ", 1) for b in bsd[1:3]]],
        "GPL-3.0-or-later": [s["gpl-free"], s["gpl-hope"] + "; without even the implied warranty of MERCHANTABILITY."], "Apache-2.0": [apache, "http://www.apache.org/licenses/LICENSE-2.0"], "MPL-2.0": [mpl],
    }
    texts, own = [], []
    for name, paragraphs in wanted.items():
        for width in (30, 70, 80, 2000):
            for mark, before, end in (("", "", ""), ("# ", "import x\n", "\nimport os"), (" * ", "/*\n", "\n */"), ("// ", "", "\r\nint x;"), ("; ", "", ""), ("!! ", "", ""), ("dnl ", "", ""), ("+", "", "")):
                lines = [line for p in paragraphs for line in [*textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False), ""]]
                texts.append(before + "\n".join((mark + line).rstrip() for line in lines) + end)
                own.append(name)
    found = license_scan.scan_licenses(documents(spark, texts)).withColumn("all", F.split("licenses", ","))
    got = {r.doc_id: r for r in found.collect()}
    assert [(i, own[i]) for i in range(len(texts)) if own[i] not in got[i].all] == []
    bare = "\n".join("\n".join(textwrap.wrap(b, 72)) for b in bsd)
    split = ["The Software\n\nwas not Released under\n\nthe MIT License", "It was never Released under\nthe MIT License", bare, s["mit-grant"].replace("Software without", "\n\nSoftware without")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(documents(spark, split)).collect()}
    assert [got[i].licenses for i in range(4)] == ["", "", "BSD-3-Clause", ""]


def test_license_families(spark):
    s = dict(license_scan.SENTENCES)
    bsd = "\n".join(s[k] for k in ("bsd-grant", "bsd-source", "bsd-binary"))
    named = s["bsd-endorse"].replace("the copyright holder", "Google Inc.")
    wanted = [
        (bsd + "\n" + named, "BSD-3-Clause"), (bsd + "\n" + "\n".join(textwrap.wrap(named.replace("Google Inc.", "the University of Somewhere Far Away"), 40)), "BSD-3-Clause"),
        (bsd + "\n" + s["bsd-advert"] + "\nThis product includes software by X.\n" + named, "BSD-4-Clause"), (bsd + "\n" + s["bsd-author"], "BSD-3-Clause"),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1. If", "MPL-1.1"), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If", "MPL-2.0"),
        ("\n".join(textwrap.wrap(s["gpl2-later"], 70)), "GPL-2.0-or-later"), ("\n".join(" * " + x for x in textwrap.wrap(s["lgpl21-later"], 60)), "LGPL-2.1-or-later"),
        ("# SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"), ("// SPDX-License-Identifier: LGPL-3.0-or-later\ncode", "LGPL-3.0-or-later"), (s["unlicense-free"], "Unlicense"),
        (s["isc-grant-and"], "ISC"), ("  " + s["boost-notice"], "BSL-1.0"), (s["agpl3-later"], "AGPL-3.0-or-later"), ("SPDX-License-Identifier: Nothing-1.0", ""),
    ]
    got = {r.doc_id: r for r in license_scan.scan_licenses(documents(spark, [t for t, _ in wanted])).collect()}
    assert [got[i].licenses for i in range(len(wanted))] == [name for _, name in wanted]
    assert got[9].best == "LGPL-3.0-or-later"


def test_native_plans_have_no_python(spark, sf_dir):
    from quantfold.llm.queries import llm_queries

    for name in ("op1_url_filters", "op2_chat_formatting", "op6_source_mixing", "op8_quality_rules", "op10_license_scans"):
        plan = llm_queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan, name


def test_sha_of_texts_is_of_utf8():
    assert hashlib.sha256("é".encode()).hexdigest().startswith("4a99557e")
