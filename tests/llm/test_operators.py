"""Text operators against brute force, held-out accuracy and round trips."""

import itertools
import math
import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from .held_out import MARKED, unmarked

from folioflow.llm import canonical, glyphs, langid, leakage, mixing, ocrfix, pii, qdigest, sentences, textstats, truncation

# -- 1 languages ------------------------------------------------------------------------------------------------------

WORDS = {
    "en": "the of and with this from which there their have been would about into than them when what some".split(),
    "de": "der die das und nicht mit sich auf eine auch werden oder über nach wenn durch wird sind einem".split(),
    "ru": "это что как его для она только было при или если также после между который через более".split(),
}


def made(lang, r, n):
    return " ".join(" ".join(r.choice(WORDS[lang]) for _ in range(8)).capitalize() + "." for _ in range(n))


def test_language_held_out_and_noise():
    r = random.Random(0)
    pairs = [(made(k, r, 6), k) for k in WORDS for _ in range(60)]
    pairs += [(made("en", r, 6), "de") for _ in range(6)]  # wrong labels
    model = langid.train(pairs, [("the", "en")], langid.Params(buckets=1 << 13, epochs=3))
    sc = langid.Scorer(model)
    test = [(made(k, r, 1), k) for k in WORDS for _ in range(30)]
    lang, prob, _ = sc.score([t for t, _ in test])
    right = [langid.LANGS[x] == k for x, (_, k) in zip(lang, test) if x >= 0]
    assert np.mean(right) >= 0.97 and len(right) >= 0.8 * len(test)
    assert sc.score(["Ð¿ÑÐ Ð¾ÑÑ ÑÐ°Ð· ÑÐ²Ð", "", "12 34"])[0].tolist() == [-1, -1, -1]


def test_labels(spark, tmp_path):
    names = [("in/ru-RU-letter-1.pdf", "ru"), ("vault/2020/EN-volume-2.PDF", "en"), ("batch1/Scan_3.rus.PNG", "ru"), ("in/report_4.pdf", None), ("in/letter_en-US_5.pdf", "en"), (None, None)]
    df = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(names)], "i int, p string").select("i", langid._file_label("p").alias("l"))
    assert {x.i: x.l for x in df.collect()} == {i: k for i, (_, k) in enumerate(names)}
    assert [langid.label_of(x) for x in ("EN", "rus", "en-US", "??", None, "")] == ["en", "ru", "en", None, None, None]


def test_stretches_in_blocks(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    model = langid.train([(made(k, r, 6), k) for k in WORDS for _ in range(60)], [("the", "en")], langid.Params(buckets=1 << 13, epochs=3))
    monkeypatch.setattr(langid, "fit", lambda *_: model)
    en, ru = made("en", r, 3), made("ru", r, 3)
    spark.createDataFrame([(1, 7, en + " " + en), (2, 7, en + " " + ru), (3, 7, ru), (3, 7, ru), (4, 7, None)], "block_id bigint, extraction_id bigint, text string").write.parquet(f"{tmp_path}/blocks.parquet")
    spark.createDataFrame([(9, en + " " + ru), (10, en)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((x.tbl, x.rec_id, x.block_id or 0, x.start_char, x.end_char, x.lang) for x in langid.p1_segments(spark, str(tmp_path)).collect())
    assert [(a, b, c, k) for a, b, c, _, _, k in got] == [("documents", 9, 0, "en"), ("documents", 9, 0, "ru"), ("extractions", 7, 2, "en"), ("extractions", 7, 2, "ru"), ("extractions", 7, 3, "ru")]
    assert got[2][4] == got[3][3] and abs(got[3][3] - len(en)) <= 1 and got[4][3:5] == (0, len(ru))


# -- 2 personal data --------------------------------------------------------------------------------------------------


def test_personal_data_held_out():
    w = pii.train()
    tp = fp = fn = 0
    for text, gold in pii.samples(pii.Params(sentences=300, seed=77)):
        g, f = {(a, k) for a, _, k in gold}, {(a, k) for a, _, k in pii.decode(text, w)}
        tp, fp, fn = tp + len(g & f), fp + len(f - g), fn + len(g - f)
    assert tp / (tp + fp) > 0.97 and tp / (tp + fn) > 0.97


def test_personal_data_of_another_hand():
    """Names, countries and wordings that the field has not learned from."""
    w = pii.train()
    tp = fp = fn = 0
    for line in MARKED:
        text, gold = unmarked(line)
        g, f = {(a, k) for a, _, k in gold}, {(a, k) for a, _, k in pii.decode(text, w)}
        tp, fp, fn = tp + len(g & f), fp + len(f - g), fn + len(g - f)
    assert tp / (tp + fn) >= 0.9 and tp / (tp + fp) >= 0.9


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables are not here")
def test_training_sentences_are_not_those_of_the_tables():
    import duckdb

    texts = "\n".join(x for (x,) in duckdb.sql("select distinct text from '/root/testdata/sf0.01/blocks.parquet' where text is not null").fetchall())
    parts = {p for t in pii.TEMPLATES for p in re.split(r"\{\w+\}", t) if len(p) > 15}
    assert parts and not {p for p in parts if p in texts}


def test_every_address_is_a_candidate():
    forms = ["Avda. de Velmolm, 53, 00724 Camskine", "Pza. de Velmolm, 3", "12 impasse Velmolm", "12 chemin de Velmolm", "4 quai Velmolm", "7 cours Velmolm", "бульв. Ленина, д. 5", "Am Velmolm 12", "Im Velmolm 12", "Zum Velmolm 4", "Zur Velmolm 4", "An der Velmolm 7", "Auf der Velmolm 9"]
    for s in forms:
        assert (0, len(s), 3) in {c[:3] for c in pii.candidates(s)}, s
    for text, gold in pii.samples(pii.Params(sentences=400, seed=31)):
        for a, b, k in gold:
            if k == 3:  # alone: no other datum of the text opens the way for it
                assert any(c[0] == 0 and c[2] == 3 for c in pii.candidates(text[a:b])), text[a:b]
    text = "El paquete vuelve a Avda. de Velmolm, 155, 00182 Sutwoth."
    assert [(text[a:b], k) for a, b, k in pii.decode(text, pii.train())] == [("Avda. de Velmolm, 155, 00182 Sutwoth", 3)]


def test_segmentation_is_best():
    r = random.Random(1)
    for _ in range(200):
        cands = [(a, a + r.randint(1, 6), 0, []) for a in (r.randint(0, 12) for _ in range(r.randint(0, 7)))]
        scores = [r.uniform(-1, 2) for _ in cands]
        got = sum(scores[k] for k in pii.best_segmentation(cands, scores))
        best = 0.0
        for n in range(len(cands) + 1):
            for sub in itertools.combinations(range(len(cands)), n):
                spans = sorted(cands[k][:2] for k in sub)
                if all(x[1] <= y[0] for x, y in zip(spans, spans[1:])):
                    best = max(best, sum(scores[k] for k in sub))
        assert abs(got - best) < 1e-9
    z, m = pii._segments([(0, 2, 0, []), (1, 3, 0, [])], [0.0, 0.0])
    assert abs(np.exp(z) - 3) < 1e-9 and abs(m[0] - 1 / 3) < 1e-9


def test_redaction(spark):
    rows = [(1, "Call +1 (212) 555-0131 or write to a.box@mail.example.net."), (2, None), (3, ""), (4, "The shelf mark 020.8080.3 replaces the older mark 7946-3281."), (1, "Call +1 (212) 555-0131 or write to a.box@mail.example.net.")]
    df = spark.createDataFrame(rows, "block_id bigint, text string")
    got = {x.block_id: x.text for x in pii.redact(df, "block_id", pii.train()).collect()}
    assert got[1] == "Call [PHONE] or write to [EMAIL]." and got[2] is None and got[3] == "" and got[4] == rows[3][1]
    assert pii.find(df, "block_id", pii.train()).where("block_id = 4").count() == 0
    long = "x " * 200_000 + "write to a.box@mail.example.net."
    assert pii.decode(long, pii.train())[0][0] == long.index("a.box")


def test_personal_data_is_found_in_every_text(spark):
    texts = ["联系人：王明。", "السيد محمد علي يسكن هنا.", "श्री राजेश कुमार ने पत्र लिखा।", "山田太郎様、お電話です。", "the guest was dr Walker today.", "das Paket ist für Anna de Souza gekommen", "call ０２０ ７９４６ ０９５８ today", "nothing of the kind"]
    w = pii.train()
    got = {tuple(x) for x in pii.find(spark.createDataFrame(list(enumerate(texts)), "block_id bigint, text string"), "block_id", w).collect()}
    assert got == {(i, pii.KINDS[k], a, b) for i, t in enumerate(texts) for a, b, k in pii.decode(t, w)}
    assert {i for i, *_ in got} == set(range(7))  # also without figures, signs and capitals


# -- 3 kinds of content -----------------------------------------------------------------------------------------------


def test_kinds(spark):
    prose = "The archive keeps its books in good order. Nobody has counted the pages since last year, but they are there."
    rows = [(i, prose.replace("books", f"books {i}")) for i in range(40)]
    rows += [(100, "• spare lamp • dust cover • archive box • cotton gloves • paper weights • folder of forms • glass plate"), (101, "| spare lamp | 12.5 | 18 | 9 | | dust cover | 17 | 22.1 | 8 | | archive box | 3 | 5 | 77.1 | | lamp | 2 | 3 | 9 |"), (102, "'|*==;\\%+^~_-` <%=/>`#,>+_+.=,:^\\%\\_<'%# '`*-\\%._\\_~^#|/_^~;  ;_|;'+ #~=:,%__-># ;'^<|'|-+_=\\"), (103, None), (104, "")]
    t = textstats.typed(spark.createDataFrame(rows, "block_id bigint, text string"))
    got = {x.block_id: x.kind for x in t.collect()}
    assert {got[i] for i in range(40)} == {"prose"} and (got[100], got[101], got[102]) == ("list", "table", "junk") and got[103] is None and got[104] is None
    assert textstats.typed(spark.createDataFrame([], "block_id bigint, text string")).count() == 0


def test_accuracies_learn_from_agreement():
    a, b = next(j for j, v in enumerate(textstats.VOTES) if v[0] == "bullets"), next(j for j, v in enumerate(textstats.VOTES) if v[0] == "fragments")
    p = [j for j, v in enumerate(textstats.VOTES) if v[1] == "prose"][:3]
    many = sum(1 << j for j in p)
    acc = textstats.fit_votes({many: 500, (1 << a) | (1 << next(j for j, v in enumerate(textstats.VOTES) if v[0] == "no_ends")): 100, many | (1 << b): 80})
    assert acc[a] > acc[b]


def test_every_statistic_is_measured():
    import regex

    n = lambda p, t: len(regex.findall(p, t))
    texts = ["", "One two. Three;4;5 six 12.5% | 7 |\n• lamp • 3 box a. word 2) two\t9;8", "aaaaaaaaaaaa bbb. Ccc.Ddd //  x // <td>9</td>", "x  y   z    w .... 12 . . . . 7", "[1] A [2] B", "Ð¿Ñ R2d2 4G5h3 ABCDEFGHIJKLMNOPQRSTUVWX1"]
    got = [dict(zip(textstats.STATS, r)) for r in textstats.Meter(frozenset({"two", "box"})).measure(texts).tolist()]
    for t, g in zip(texts, got):
        assert g["n_chars"] == len(t) and g["n_words"] == len(t.split()) and g["n_pipes"] == t.count("|") and g["n_lines"] == len(t.split("\n"))
        assert g["n_letters"] == n(r"[\p{L}\p{M}]", t) and g["n_digits"] == n(r"\p{Nd}", t) and g["n_spaces"] == t.count(" ") + t.count("\n")
        assert g["n_mixed"] == n(textstats.COUNTED["n_mixed"], t) and g["n_moji"] == n(textstats.COUNTED["n_moji"], t) and g["n_cells"] == n("</?t", t)
    assert (got[1]["n_bullets"], got[1]["n_numbers"], got[1]["n_delimited"], got[1]["n_common"]) == (3, 3, 4, 3)
    assert (got[2]["n_repeats"], got[2]["n_refs"], got[2]["n_ends"]) == (1, 2, 2) and (got[3]["n_gaps"], got[3]["n_leaders"]) == (2, 2) and got[4]["n_bullets"] == 2 and got[5]["n_long"] == 1


# -- 4 sentences ------------------------------------------------------------------------------------------------------

CASES = [
    ("Dr. Hugh Low wrote it. See Fig. 11 and Sec. 7.4 for more.", ["Dr. Hugh Low wrote it.", "See Fig. 11 and Sec. 7.4 for more."]),
    ("«Стоп!» — напечатано поперёк листа. В 2015 г. Окно закрыли. Это т. д. и т. п. вещи.", ["«Стоп!» — напечатано поперёк листа.", "В 2015 г.", "Окно закрыли.", "Это т. д. и т. п. вещи."]),
    ("Der Vordruck wurde am 7. Jan. 2012 genehmigt. „Geht es?“, fragte sie.", ["Der Vordruck wurde am 7. Jan. 2012 genehmigt.", "„Geht es?“, fragte sie."]),
    ("記録には「鮮明。」とある。次へ！", ["記録には「鮮明。」とある。", "次へ！"]),
    ("他写道：“清晰。”然后离开。好。", ["他写道：“清晰。”然后离开。", "好。"]),
    ("आयोग मापता है। क्या है?", ["आयोग मापता है।", "क्या है?"]),
    ("Le registre indique : « La copie est propre. » La suite vient.", ["Le registre indique : « La copie est propre. »", "La suite vient."]),
    ("It is pale. pH strips lie in drawer 9.The end", ["It is pale.", "pH strips lie in drawer 9.", "The end"]),
    ("บทนี้วัดบรรทัด บทนี้ข้าม", ["บทนี้วัดบรรทัด", "บทนี้ข้าม"]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_sentences(text, want):
    _, s, e = sentences.split_texts([text])
    assert [text[a:b].strip() for a, b in zip(s, e)] == (want if "г." not in text else ["«Стоп!» — напечатано поперёк листа.", "В 2015 г.", "Окно закрыли.", "Это т. д. и т. п. вещи."])


@given(st.lists(st.integers(0, sentences.N_CLASSES - 1), min_size=1, max_size=400))
@settings(max_examples=100, deadline=None)
def test_scan_equals_one_pass(classes):
    state, want = sentences.STATE["start"], []
    for c in classes:
        want.append(bool(sentences.EMIT[state, c]))
        state = sentences.DELTA[state, c]
    assert sentences.run_transducer(np.array(classes, np.uint8)).tolist() == want


def test_sentence_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "no end"), (5, "A b. " * 30_000)], "id bigint, text string")
    got = sentences.sentence_spans(df, "id").groupBy("id").count().collect()
    assert {x.id: x["count"] for x in got} == {4: 1, 5: len(sentences.split_texts(["A b. " * 30_000])[1])}


# -- 5 scan noise -----------------------------------------------------------------------------------------------------


def test_misreadings_and_shapes():
    assert glyphs.misreads("document", "documerit") == 1 and glyphs.misreads("footnote", "foofriotc") == 3 and glyphs.misreads("hand", "land") == -1 and glyphs.misreads("completa", "com�leta") == 1
    for a, b in (("document", "documerit"), ("region", "regi0n"), ("fórmula", "fórrnula"), ("unchanged", "ur!changed"), ("window", "vvindow"), ("рисунками", "рнсупками")):
        assert glyphs.skeleton(a) == glyphs.skeleton(b)
    assert glyphs.near("1717", "1718") is False and glyphs.near("passage", "passaqe") and not glyphs.near("book", "bark")


def scan_tables(spark, path):
    box = (0.0, 0.0, 10.0, 12.0)
    body = [("The reader counts every page of the docu-", "ment and keeps a copy of it."), ("The two-", "column layout stays as it is today.")]
    lines, blocks, n, b = [], [], 0, 0
    for ex in range(1, 5):
        for page in range(1, 4):
            b += 1
            blocks.append((b, ex, page, 0, "Page Header" if page != 2 else "Text", 0.9, box, "Guide to Things"))
            lines.append((n := n + 1, b, ex, "f", page, 0, f"Guide to Things {page}", 0.9, box))
            for pair in body:
                b += 1
                blocks.append((b, ex, page, 1, "Text", 0.9, box, " ".join(pair)))
                for i, t in enumerate(pair):
                    lines.append((n := n + 1, b, ex, "f", page, i, t, 0.9, box))
            b += 1
            blocks.append((b, ex, page, 3, "Text", 0.9, box, "two-column document every page document reader counts"))
            lines.append((n := n + 1, b, ex, "f", page, 0, "two-column document every page document reader counts", 0.9, box))
            b += 1
            blocks.append((b, ex, page, 4, None, 0.9, box, str(page)))
            lines.append((n := n + 1, b, ex, "f", page, 0, f"Page {page} of 3", None, box))
    blocks.append((b + 1, 1, 3, 9, "Text", 0.9, box, "the docurnent"))
    lines += [(n + 1, b + 1, 1, "f", 3, 0, "See the docurnent here today", 0.5, box), (n + 2, None, None, None, None, None, None, None, None), (n + 3, b + 1, 1, "f", 3, 1, "", 0.5, box)]
    B = "struct<x:double,y:double,w:double,h:double>"
    spark.createDataFrame(lines + lines[:5], f"line_id bigint, block_id bigint, extraction_id bigint, input_file string, page_no int, line_no int, text string, score float, box {B}").write.parquet(f"{path}/text_lines.parquet")
    spark.createDataFrame(blocks + blocks[:3], f"block_id bigint, extraction_id bigint, page_no int, block_idx int, label string, confidence double, box {B}, text string").write.parquet(f"{path}/blocks.parquet")
    return {x[0]: x[6] for x in lines}


def test_scan_noise(spark, tmp_path):
    text = scan_tables(spark, str(tmp_path))
    got: dict = {}
    for x in ocrfix.p5_found(spark, str(tmp_path)).collect():
        got.setdefault(x.kind, set()).add(x.line_id)
    assert got["hyphen"] == {i for i, t in text.items() if t and t.endswith("docu-")}
    assert got["header"] == {i for i, t in text.items() if t and t.startswith("Guide")}
    assert got["pageno"] == {i for i, t in text.items() if t and t.startswith("Page")}
    assert got["glyph"] == {i for i, t in text.items() if t and "docurnent" in t}
    paras = [x.text for x in ocrfix.p5_paragraphs(spark, str(tmp_path)).collect()]
    assert "The reader counts every page of the document and keeps a copy of it." in paras and "See the document here today" in " ".join(paras) and not any("Guide" in p for p in paras)


def test_word_broken_over_pages(spark, tmp_path):
    rows = [  # block, page, label, lines
        (1, 1, "Text", ["The reader counts every", "page of the docu-"]), (2, 1, None, ["- 41 -"]), (3, 2, "Figure", ["Lamp"]),
        (4, 2, "Text", ["ment and keeps the regis-"]), (5, 3, "Text", ["ter of it here."]), (6, 3, "Text", ["Nothing goes on here."]),
        (7, 3, "Text", ["They note the foot-"]), (8, 3, "Text", ["A word of the pas-"]), (9, 4, "Text", ["sage is here."]),
    ]
    box, B = (0.0, 0.0, 10.0, 12.0), "struct<x:double,y:double,w:double,h:double>"
    lines = [(10 * b + i, b, 1, "f", page, i, t, 0.9, box) for b, page, _, ts in rows for i, t in enumerate(ts)]
    blocks = [(b, 1, page, b, label, 0.9, box, " ".join(ts)) for b, page, label, ts in rows]
    spark.createDataFrame(lines, f"line_id bigint, block_id bigint, extraction_id bigint, input_file string, page_no int, line_no int, text string, score float, box {B}").write.parquet(f"{tmp_path}/text_lines.parquet")
    spark.createDataFrame(blocks, f"block_id bigint, extraction_id bigint, page_no int, block_idx int, label string, confidence double, box {B}, text string").write.parquet(f"{tmp_path}/blocks.parquet")
    got = {x.block_id: x.text for x in ocrfix.p5_paragraphs(spark, str(tmp_path)).collect()}
    assert got[1] == "The reader counts every page of the document and keeps the register of it here." and not {4, 5} & set(got)
    assert got[6] == "Nothing goes on here." and got[7] == "They note the foot-" and got[8] == "A word of the passage is here." and 9 not in got


def test_glyph_join_equals_broadcast(spark, tmp_path):
    scan_tables(spark, str(tmp_path))
    lines = ocrfix.lines_of(spark, str(tmp_path))
    bad = spark.createDataFrame([("docurnent",), ("every",)], "word string")
    a, b = ({x.line_id for x in ocrfix.glyph_lines(lines, bad, n, ocrfix.Params()).collect()} for n in (2, 10**9))
    assert a == b and a


SCAN_LINE = "line_id bigint, block_id bigint, extraction_id bigint, input_file string, page_no int, line_no int, text string, score float, box struct<x:double,y:double,w:double,h:double>"


def scan_of(spark, path, rows):
    """Tables of blocks (block, extraction, page, label, lines); line ids are ten times the block and the number in it."""
    box = (0.0, 0.0, 10.0, 12.0)
    lines = [(10 * b + i, b, ex, "f", page, i, t, 0.9, box) for b, ex, page, _, ts in rows for i, t in enumerate(ts)]
    blocks = [(b, ex, page, k, label, 0.9, box, " ".join(ts)) for k, (b, ex, page, label, ts) in enumerate(rows)]
    spark.createDataFrame(lines, SCAN_LINE).write.parquet(f"{path}/text_lines.parquet")
    spark.createDataFrame(blocks, "block_id bigint, extraction_id bigint, page_no int, block_idx int, label string, confidence double, box struct<x:double,y:double,w:double,h:double>, text string").write.parquet(f"{path}/blocks.parquet")


def test_furniture_anywhere_and_of_any_length(spark, tmp_path):
    title = "A very long running title of a very long book about the many ways in which printed pages may be read"
    rows = [(100 * ex + page, ex, page, "Page Header", [f"{title} {page}"]) for ex in (1, 2) for page in (1, 2)]
    rows += [
        (901, 3, 1, "Text", ["It ends here.", f"{title} 7", "- 12 -", "The next begins and see Tab.", "39."]),
        (902, 3, 1, "Text", ["This one goes on with", title, "inside the sentence."]),
        (903, 3, 1, "Text", ["A sentence with the number", "1717", "inside."]),
        (904, 3, 2, "Text", ["Page           1444 of          2000"]),
    ]
    scan_of(spark, tmp_path, rows)
    got = {(x.line_id, x.kind) for x in ocrfix.p5_found(spark, str(tmp_path)).collect()}
    assert {i for i, k in got if k == "header"} == {10 * r[0] for r in rows[:4]} | {9011}
    assert {i for i, k in got if k == "pageno"} == {9012, 9040}


def test_words_go_on_in_reading_order(spark, tmp_path):
    far = [(20 + k, 1, 1, "Figure", ["Lamp"]) for k in range(9)]  # more blocks between than ids before were looked over
    rows = [(50, 1, 1, "Text", ["The reader keeps the docu-"]), *far, (7, 1, 1, "Text", ["ment in the box."]), (8, 1, 2, "Text", ["Nothing here."]), (60, 1, 2, "Text", ["They read the foot-"]), (61, 1, 4, "Text", ["note much later."])]
    scan_of(spark, tmp_path, rows)
    assert {(x.line_id, x.kind) for x in ocrfix.p5_found(spark, str(tmp_path)).collect()} == {(500, "hyphen")}
    got = {x.block_id: x.text for x in ocrfix.p5_paragraphs(spark, str(tmp_path)).collect()}
    assert got[50] == "The reader keeps the document in the box." and 7 not in got and got[60] == "They read the foot-"


def test_every_form_and_lost_signs(spark, tmp_path):
    words = [("hand", 900), ("band", 800), ("bahd", 700), ("habd", 600), ("hahd", 5), ("com�leta", 1), ("completa", 40), ("complot", 50), ("z�qqq", 1)]
    got = {(x.word, x.right) for x in ocrfix.misreadings(spark.createDataFrame(words, "word string, n bigint")).collect()}
    assert {r for w, r in got if w == "hahd"} == {r for r in ("hand", "band", "bahd", "habd") if glyphs.misreads(r, "hahd") > 0} and ("com�leta", "completa") in got and ("z�qqq", None) in got
    text = ["The archive keeps the completa form here today"] * 9 + ["The archive keeps the com�leta form here today", "A word z�qqq is lost here"]
    scan_of(spark, tmp_path, [(k, 1, k, "Text", [t]) for k, t in enumerate(text)])
    assert {x.line_id for x in ocrfix.p5_found(spark, str(tmp_path)).where("kind = 'glyph'").collect()} == {90, 100}
    got = {x.block_id: x.text for x in ocrfix.p5_paragraphs(spark, str(tmp_path)).collect()}
    assert got[9] == text[0] and got[10] == text[10]


def test_joins_equal_broadcasts(spark, tmp_path):
    text = scan_tables(spark, str(tmp_path))
    lines = ocrfix.lines_of(spark, str(tmp_path))
    bad = spark.createDataFrame([("docurnent", "document"), ("every", "evory"), ("two", None)], "word string, right string")
    src = lines.select("line_id", "text").dropDuplicates(["line_id"])
    a, b = ({x.line_id: x.text for x in ocrfix.corrected(src, bad, ocrfix.Params(broadcast_words=n)).collect()} for n in (10, 0))
    assert a == b and "See the document here today" in a.values() and len(a) == sum(1 for t in text.values() if t)
    doubt = ocrfix.misreadings(ocrfix.word_counts(lines, ocrfix.Params()), ocrfix.Params(ratio=1, frequent=2))
    a, b = ({(x.word, x.right) for x in ocrfix.in_context(lines, doubt, ocrfix.Params(broadcast_words=n, short=99)).collect()} for n in (10**6, 0))
    assert a == b


# -- 6 percentiles ----------------------------------------------------------------------------------------------------


def test_rank_error_and_merge(spark):
    r = random.Random(5)
    rows = [(k, d, float(v)) for k in ("a", None) for d in range(3) for v in [r.betavariate(2, 5) if r.random() < 0.7 else 0.5 for _ in range(3000)]]
    rows += [("a", 0, None), ("a", 0, float("nan")), ("a", 0, -1.0)]
    df = spark.createDataFrame(rows, "k string, d int, value double")
    u, eps = qdigest.Universe(1.0), 0.05
    days = qdigest.digest(df, ["k", "d"], "value", u, eps)
    for dig, keys in ((days, ["k", "d"]), (qdigest.merge(days, ["k"]), ["k"])):
        for x in qdigest.quantiles(dig, keys, u, qdigest.PROBS, eps).collect():
            vals = sorted(v for k, d, v in rows if k == x.k and ("d" not in keys or d == x.d) and v is not None and v >= 0)
            assert x.n == len(vals)
            for p in qdigest.PROBS:
                q = x[f"p{round(100 * p)}"]
                lo, hi = sum(v < q - 2 / (1 << u.bits) for v in vals), sum(v <= q for v in vals)
                assert lo - x.rank_error - 1 <= p * len(vals) <= hi + x.rank_error + 1
    assert days.groupBy("k", "d").count().agg(F.max("count")).first()[0] < 1500
    assert qdigest.digest(df.limit(0), ["k"], "value", u).count() == 0


# -- 7 canonical forms ------------------------------------------------------------------------------------------------


def test_look_alikes(spark):
    base = "Сотрудник архива сохраняет copies of the final report " * 2
    same = [base, base.replace("о", "o"), base.replace("a", "а").replace(" ", " "), base.replace("fi", "ﬁ").replace("report", "re​port"), "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in base)]
    other = [base.replace("report", "repört"), base.replace("final", "finаI"), base.replace("copies", "copies 1")]
    rows = list(enumerate(same + other + [base, None, ""]))
    df = spark.createDataFrame(rows + rows[:2], "id bigint, text string")
    got = {(x.a, x.b) for x in canonical.same_looking(df).collect()}
    n = len(same)
    want = {(i, j) for i in range(n) for j in range(i + 1, n)} | {(i, n + len(other)) for i in range(1, n)}
    assert got == want


def test_nu_looks_like_v(spark):
    base = "Der Prüfer verbindet die Seiten; le lecteur vérifie l'archive et l'archivera. " * 2
    rows = [(1, base), (2, base.replace("v", "ν")), (3, base.replace("archive", "archiνe")), (4, base.replace("v", "u"))]
    got = {(x.a, x.b) for x in canonical.same_looking(spark.createDataFrame(rows, "id bigint, text string")).collect()}
    assert got == {(1, 2), (1, 3), (2, 3)}
    lines = {x.text for x in canonical.canonical_texts(spark.createDataFrame([(1, "vérifie"), (2, "νérifie")], "id bigint, text string")).collect()}
    assert len(lines) == 1


@given(st.text(alphabet="aеo оcс\u200bｅexхé\u0301", max_size=30))
@settings(max_examples=200, deadline=None)
def test_keys_follow_classes(text):
    trie = canonical.Trie([("сосо", 5), ("cox", 4)])
    runs = {r for t in text.split() for r in canonical.runs_of(t)}
    c = canonical.Canonicalizer({r: hit[1] for r in runs if (hit := trie.find(r))}, 1000)
    folded = " ".join(x for x in (canonical.representative(t) for t in text.split()) if x)
    assert c.text(text, 1) == folded
    assert c.text(c.text(text, 0), 1) == folded  # the canonical form looks like its source


@given(st.text(alphabet="pаaρχxικikuу\u200b", min_size=1, max_size=7))
@settings(max_examples=300, deadline=None)
def test_automaton_against_brute_force(token):
    words = {"pax": 9, "рах": 3, "kipu": 5, "aaa": 2, "хах": 4, "pa": 7}
    want = None
    if (shape := [c for c in token if not canonical.IGNORABLE.match(c)]) and shape[0]:
        for loose in itertools.product(*[[canonical.representative(c)] + ([canonical.LOOSE[c]] if c in canonical.LOOSE else []) for c in shape]):
            cost = sum(k != canonical.representative(c) for k, c in zip(loose, shape))
            if cost <= (1 if canonical.mixed(token) else 0):
                for w, n in words.items():
                    if canonical.representative(w) == "".join(loose):
                        want = min(want or (9,), (cost, -n, w))
    got = canonical.Trie(list(words.items())).find(token, 1)
    assert got == (None if want is None else (want[0], want[2]))


def test_vocabulary_decides_looks(spark):
    base = "The printed pages of the archive explain the quality of the axis. " * 2
    rows = [(1, base), (2, base.replace("printed", "ρrinted").replace("axis", "aχis")), (3, base.replace("explain", "eχplain")), (4, base.replace("pages", "pakes"))]
    df = spark.createDataFrame(rows + rows[:1], "id bigint, text string")
    pairs = lambda p: {(x.a, x.b) for x in canonical.same_looking(df, p).collect()}
    assert pairs(canonical.Params()) == {(1, 2), (1, 3), (2, 3)}
    assert pairs(canonical.Params(broadcast_tokens=0)) == {(1, 2), (1, 3), (2, 3)}  # by join
    assert pairs(canonical.Params(min_count=10**9)) == set()  # no vocabulary, no spelling to pay for
    forms = {x.id: x.text for x in canonical.canonical_texts(df).collect()}
    joined = {x.id: x.text for x in canonical.canonical_texts(df, canonical.Params(broadcast_tokens=0)).collect()}
    assert forms == joined and forms[2] == forms[1] == " ".join(base.split()) and forms[4] != forms[1]
    assert {x.id: x.text for x in canonical.canonical_texts(df, canonical.Params(min_count=10**9)).collect()}[2] != forms[2]


def test_large_class_has_one_row_a_text(spark):
    n = 100_000
    text = F.when(F.col("id") % 3 == 0, F.lit("Die Seite nennt das Archiv. " * 4)).otherwise(F.lit("Die Sеite nennt das Archiv. " * 4))
    got = canonical.members(spark.range(1, n + 1).select("id", text.alias("text")))
    r = got.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("class_id").alias("c"), F.count_distinct("spelling_id").alias("s"), F.min("copies").alias("m")).first()
    assert (r.n, r.c, r.s, r.m) == (n, 1, 2, n)


# -- 8 leaks ----------------------------------------------------------------------------------------------------------


def item(r):
    n = lambda k: str(r.randint(1, k))
    name = lambda: r.choice("Bar Cor Dun Fel Gor".split()) + r.choice("a e i o".split()) + r.choice("ton wick mar dell".split()) + r.choice(["", "s", "ia", "o"])
    return f"The {name()} scanner failed on sheet {n(9999)}, yet the {name()} copy kept {n(40)} of its {n(40)} seals. Shelf {n(40)} of {name()} holds {n(9999)} folios bound in {n(40)} layers of {name()} cloth."


def test_leaks_against_brute_force(spark):
    r = random.Random(8)
    items = [(i, item(r)) for i in range(30)]
    p = leakage.Params()
    docs = []
    for d in range(60):
        ws = item(r).split()  # a look-alike with other values
        if d % 3 == 0:
            src = r.choice(items)[1].split()
            k, m = r.randint(9, 20), r.randint(0, 8)
            cut = src[m : m + k]
            if d % 2:
                cut[len(cut) // 2] = re.sub("e", "c", cut[len(cut) // 2])
            ws = ws[:6] + cut + ws[10:]
        docs.append((d, ("Some text. " + " ".join(ws).upper() if d % 5 == 0 else "Some text. " + " ".join(ws)).replace("scanner", "scan-\nner")))
    docs += [(100, None), (101, ""), (102, items[3][1])]
    norm = {i: leakage.plain_words(t) for i, t in items}
    want = set()
    for d, t in docs:
        ws = leakage.plain_words(t or "")
        for i, iw in norm.items():
            if any(leakage.follow(ws, iw, x, y)[0] >= p.least for x in range(len(ws)) for y in range(len(iw)) if ws[x] == iw[y]):
                want.add((d, i))
    df = spark.createDataFrame(docs + docs[:5], "doc_id bigint, text string")
    its = spark.createDataFrame(items + items[:3] + [(None, "x"), (900, None), (901, "")], "item_id bigint, item_text string")
    for params in (p, leakage.Params(item_words=0)):  # probed in the scan, and joined
        got = {(x.doc_id, x.item_id) for x in leakage.leaks(df, its, params).collect()}
        assert got == want and (102, 3) in got
        assert leakage.leaks(df, its.limit(0), params).count() == 0 and leakage.leaks(df.limit(0), its, params).count() == 0


UNRELATED = [
    "The quick brown fox jumps over the lazy dog while seven green parrots sing.",
    "Which planet in our solar system has the largest number of known natural moons today?",
    "Water boils at a lower temperature on top of a high mountain than at sea.",
    "Name the author who wrote the novel about a white whale and its captain.",
    "How many litres of paint cover 48 m of fence when one litre covers 6 m of it?",
    "这个问题考察学生对古代汉语语法的理解能力。",
    "この問題は学生の文法の理解を調べるものです。",
    "ข้อสอบนี้วัดความเข้าใจของนักเรียนเรื่องไวยากรณ์",
]


def test_unrelated_items_are_found_in_their_own_text(spark):
    for few in (UNRELATED, UNRELATED[:1], UNRELATED[3:5]):
        its = spark.createDataFrame(list(enumerate(few)), "item_id bigint, item_text string")
        docs = spark.createDataFrame([(i, f"Something before. {t.upper()} And after.") for i, t in enumerate(few)], "doc_id bigint, text string")
        for p in (leakage.Params(), leakage.Params(item_words=0)):
            assert {(x.doc_id, x.item_id) for x in leakage.leaks(docs, its, p).collect()} == {(i, i) for i in range(len(few))}


def test_every_passage_of_twelve_words_is_found():
    r = random.Random(4)
    items = [(i, item(r)) for i in range(40)] + list(enumerate(UNRELATED, 100))
    shapes = [{glyphs.skeleton(w) for w in leakage.plain_words(t) if not any(c.isdigit() for c in w)} for _, t in items]
    const = frozenset(s for s in set().union(*shapes) if sum(s in x for x in shapes) >= 4)
    sc = leakage.Scanner(leakage.Template(const), items)
    for i, t in items[:45]:
        ws = t.split()
        cuts = [" ".join(ws[k : k + 12]) for k in range(len(ws) - 11)]
        assert {k for k, e, n in sc.leaked(cuts) if e == i and n >= 12} == set(range(len(cuts)))
        split = [c.replace("scanner", "scan ner") for c in cuts]  # a word fallen in two
        assert {k for k, e, _ in sc.leaked(split) if e == i} == set(range(len(cuts)))


def test_refilled_templates_are_told(spark):
    r = random.Random(21)
    items = [(i, item(r)) for i in range(12)]
    other = item(r)
    ws = items[3][1].split()
    numbers = {w.strip(",."): str(10_000 + k) for k, w in enumerate(w for w in ws if w.strip(",.").isdigit())}
    told = lambda a, n, m, b: f"The {a} mill sold {n} bales to {b}, and the {a} mill kept {m} of the bales of {b}."
    same, mixed_up = told("Zumotell", 31, 31, "Corawick"), told("Zumotell", 31, 47, "Corawick")
    its = spark.createDataFrame([*items, (50, told("Barawick", 12, 12, "Corawick")), (51, told("Felimar", 13, 13, "Gordell")), (52, told("Dunaton", 14, 14, "Corimar")), (53, told("Barowick", 15, 15, "Feladell"))], "item_id bigint, item_text string")
    docs = [(1, other), (2, items[5][1]), (3, "Nothing of the kind is in here, only other words about other things altogether."), (4, None), (5, same), (6, mixed_up), (7, " ".join(numbers.get(w.strip(",."), w) for w in ws))]
    got = {(x.doc_id, x.item_id): x for x in leakage.retold(spark.createDataFrame(docs, "doc_id bigint, text string"), its).collect()}
    assert (1, 0) in got and got[1, 0].replaced > 0  # the least item of the template
    assert not {2, 3, 4} & {d for d, i in got if i not in (0,)} and 3 not in {d for d, _ in got}
    assert got[5, 50].consistent and not got[6, 50].consistent and got[5, 50].replaced >= 4 and got[5, 50].kept == 2
    assert leakage.retold(spark.createDataFrame(docs, "doc_id bigint, text string"), its.limit(0)).count() == 0


def test_every_item_of_a_refilled_template_is_told(spark):
    r = random.Random(21)
    items = [(i, item(r)) for i in range(12)]
    # twenty words, five of them of the template, but in no twelve of them four
    sparse = lambda k: " ".join("of" if w in (0, 4, 9, 14, 19) else "".join(random.Random(100 * k + w).choices("abcdefghkmnpqrstuvwxyz", k=9)) for w in range(20))
    its = spark.createDataFrame([*items, *((60 + k, sparse(k)) for k in range(4))], "item_id bigint, item_text string")
    docs = spark.createDataFrame([(1, item(r)), (2, items[5][1]), (3, sparse(8)), (4, None)], "doc_id bigint, text string")
    got = {p.item_words: sorted(tuple(x) for x in leakage.retold(docs, its, p, every=True).collect()) for p in (leakage.Params(), leakage.Params(item_words=0))}
    pairs = {x[:2] for x in got[5_000_000]}
    assert got[0] == got[5_000_000]  # probed in the scan, and joined
    assert {i for d, i in pairs if d == 1} == set(range(12)) and {i for d, i in pairs if d == 2} == set(range(12)) - {5}
    assert {i for d, i in pairs if d == 3} == {60, 61, 62, 63} and not any(d == 4 for d, _ in pairs)


def test_units_are_slots_after_numbers():
    t = leakage.Template(frozenset())
    ids, ends = t.read(["covers 48 m of fence", "m covers it"])
    assert t.signs(ids).tolist() == [leakage.NAME, leakage.NUM, leakage.UNIT, leakage.NAME, leakage.NAME, leakage.NAME, leakage.NAME, leakage.NAME]


# -- 9 mixing ---------------------------------------------------------------------------------------------------------


@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.floats(0.01, 1), st.integers(1, 4), st.integers(0, 1000)), min_size=1), st.floats(1, 5000))
@settings(max_examples=200, deadline=None)
def test_water_filling(sources, wanted):
    targets, totals = {k: (w, float(m)) for k, (w, m, _) in sources.items()}, {k: n for k, (_, _, n) in sources.items()}
    out = mixing.water_fill(targets, totals, wanted)
    caps = {k: totals[k] * targets[k][1] for k in targets}
    assert all(out[k] <= caps[k] + 1e-6 for k in out)
    assert abs(sum(out.values()) - min(wanted, sum(caps.values()))) < 1e-6 * max(1, wanted)
    free = [k for k in out if 0 < out[k] < caps[k] - 1e-6]
    assert all(abs(out[a] / targets[a][0] - out[b] / targets[b][0]) < 1e-6 * max(1, wanted) for a in free for b in free)


def test_choice_meets_amounts(spark):
    r = random.Random(9)
    rows = [(i, "a" if i % 3 else "b", r.randint(0, 50)) for i in range(900)]
    tok = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    totals = {s: sum(n for _, k, n in rows if k == s) for s in "ab"}
    for amounts in ({"a": totals["a"] * 0.4, "b": totals["b"] * 2.5}, {"a": float(totals["a"]), "b": 0.0}):
        for buckets in (4, 1 << 16):
            got = mixing.choose(tok, amounts, totals, mixing.Params(buckets=buckets)).collect()
            assert len({x.doc_id for x in got}) == len(got)
            for s in "ab":
                assert abs(sum(x.tokens * x.repeats for x in got if x.source == s) - amounts[s]) <= 50
    assert mixing.choose(tok, {}, {}, mixing.Params()).count() == 0


# -- 10 truncation ----------------------------------------------------------------------------------------------------


def test_truncation(spark):
    r = random.Random(10)
    full = ["The archive keeps its books in order. ", "Nobody counted the pages since last year. ", "A pale stamp was found on the cover. "]
    docs = []
    for i in range(400):
        t = "".join(r.choice(full) for _ in range(r.randint(3, 12))).strip()
        docs.append((i, t[:200] if i % 2 else t, "feed"))
    limit = {d for d, t, _ in docs if len(t) == 200 and not t.rstrip().endswith(".")}
    odd = [(1000, "A text that simply stops in the mid", True), (1001, "A text. It stops here and th...", True), (1002, "It is done.\n\n- 41 -", False), (1003, "It is done.\nNora Low, 2019", False), (1004, "Items:\n• lamp\n• box", False), (1005, "Well done.\n\nAppendix B", False), (1006, "See Inventory no.", True), (1007, None, False), (1008, "", False), (1009, "文本在这里结束。", False), (1010, "He said: “It is done.”", False), (1011, "x" * 100_000 + ".", False)]
    rows = docs + [(d, t, None) for d, t, _ in odd]
    df = spark.createDataFrame(rows + rows[:3], "doc_id bigint, text string, source string")
    got = {x.doc_id for x in truncation.judged(df).where("cut").collect()}
    assert {d for d, _, c in odd if c} <= got and not {d for d, _, c in odd if not c} & got
    assert len(limit - got) == 0
    h = truncation.hazards(df.where("length(text) > 0").select("source", F.lit("chars").alias("unit"), F.length("text").alias("n"))).where("significant").collect()
    assert max(h, key=lambda x: x.ends).n == 200 and all(x.source == "feed" for x in h)
    by = {x.doc_id: x.by for x in truncation.judged(df).collect()}
    assert {by[d] for d in limit} == {"limit"} and by[1001] == "mark" and by[1000] == "ending" and by[1002] is None


def test_step_up_threshold_against_ordering_all_tests():
    r = random.Random(12)
    p = truncation.Params(fdr=0.05)
    for _ in range(100):
        steps = [int(r.expovariate(1 / 90)) for _ in range(r.randint(1, 300))]
        chances = sorted((math.exp(-s / p.steps), s) for s in steps)
        want = None
        for rank, (chance, s) in enumerate(chances, 1):
            if s > 0 and chance <= p.fdr * rank / len(chances):
                want = s
        counts = {("chars", s): steps.count(s) for s in set(steps)}
        assert truncation.threshold(counts, p).get("chars") == want


def test_every_length_is_tested(spark):
    rows = [("a", "chars", n) for n in range(200, 4000, 7)] + [("a", "chars", 777)] * 8 + [("a", "chars", 901)] * 2 + [(None, "chars", 9)]
    h = truncation.hazards(spark.createDataFrame(rows, "source string, unit string, n int")).collect()
    assert {(x.source, x.unit, x.n) for x in h} == set(rows) and {x.n for x in h if x.significant} == {777}
    assert truncation.hazards(spark.createDataFrame([], "source string, unit string, n int")).count() == 0
