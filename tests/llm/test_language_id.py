"""Held-out accuracy, and the cutting of mixed texts."""

from __future__ import annotations

from conftest import DATA

from pustaka.llm.language_id import fit, language_segments, relabelled, segments, stretches, train


def model_and_rest(spark):
    d = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.1')}/documents.parquet").filter("lang IS NOT NULL").selectExpr("doc_id", "lang", "substring(text, 1, 400) AS t").orderBy("doc_id").limit(900).collect()
    pairs = [(r["lang"], r["t"]) for r in d]
    return fit([], pairs[:450]), pairs[450:]


def test_held_out(spark):
    model, rest = model_and_rest(spark)
    got = [(g, segments(t, model)) for g, t in rest]
    got = [(g, s) for g, s in got if s]
    assert sum(max(s, key=lambda x: x[2])[0] == g for g, s in got) >= 0.98 * len(got)
    assert all(0 <= c <= 1 for _, s in got for _, c, _ in s)


def test_stretches():
    t = "Q.12) Why did the river towns grow? हाल GST के वर्षों में जल नीति बदली है। || What changed in the hill towns? (150 words) 10"
    assert [len(w) for w in stretches(t)] == [6, 8, 6]
    assert [len(w) for w in stretches("One two. Three four five six. सात आठ.")] == [6, 2]
    assert stretches("") == [] and stretches("(150 words) 12. [15 marks]") == []


def test_rows(spark):
    sf = DATA.replace("sf0.001", "sf0.01")
    q, lab = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("ocr_questions", "ocr_labels"))
    model = train(q, lab)
    rows = [
        (1, "Kya aap maante hain ki jal prabandhan se gramin mahilaon ka jeevan behtar hua hai? Tark sahit uttar dijiye.", "en", 1),
        (2, "Explain how the river towns changed since the reform of water policy.", "en", 1),
        (3, "Explain how the river towns changed since the reform. / क्या आप मानते हैं कि जल प्रबंधन से ग्रामीण महिलाओं का जीवन बेहतर हुआ है?", "en", 1),
        (4, "गेल्या काही वर्षांत या जिल्ह्यात पाणी व्यवस्थापन यासाठी केलेल्या उपायांचे परीक्षण करा.", " ", 1),
        (5, None, None, 1),
        (6, "", "und", 1),
        (7, "Two words", None, 1),
        (8, "Explain how the river towns changed since the reform. " * 3000, None, 1),
    ]
    df = spark.createDataFrame(rows, "ocr_id long, text string, lang string, n_words int")
    segs = language_segments(df, model)
    got = {}
    for r in relabelled(segs, df).orderBy("ocr_id", "seg_no").collect():
        got.setdefault(r["ocr_id"], []).append((r["seg_no"], r["lang"]))
    assert got == {1: [(1, "hi")], 3: [(1, "en"), (2, "hi")], 4: [(1, "mr")], 8: [(1, "en")]}
    assert language_segments(df.limit(0), model).count() == 0


def test_nothing_to_learn_from():
    assert isinstance(segments("Explain how the river towns changed.", fit([], [])), list)
