import pytest
from pyspark.sql import functions as F

from tallyframe.functions import lexicons as lex
from tallyframe.operators import features as ft


def token(form, lemma=None, pos="NOUN", sent=0, alpha=True, **morph):
    return (form, lemma or form.lower(), pos, {k: str(v) for k, v in morph.items()}, alpha, sent)


def answers(spark, *rows):
    return spark.createDataFrame([(i, text, toks, n) for i, (text, toks, n) in enumerate(rows)], f"id int, text string, tokens {ft.TOKEN}, n_sentences int")


def extract(spark, toks, text="", n=1, blocks=ft.SETS["lexical"]):
    return ft.extract(answers(spark, (text, toks, n)), blocks).first().asDict()


def test_widths_and_order():
    assert len(ft.feature_names("lexical")) == 51 and len(ft.feature_names("affect")) == 21 and len(ft.feature_names("lexical-affect")) == 72
    assert len(set(ft.feature_names("lexical-affect"))) == 72


def test_person(spark):
    fin = {"VerbForm": "Fin", "Person": 1, "Number": "Sing"}
    toks = [token("yo", pos="PRON", Person=1, Number="Sing", Case="Nom"), token("duermo", pos="VERB", **fin), token("como", pos="VERB", **fin), token("ellos", pos="PRON", Person=3, Number="Plur"), token("nosotros", pos="PRON", Person=1, Number="Plur")]
    got = extract(spark, toks, blocks=("person",))
    assert got["fps_verb_rate"] == 40 and got["fps_pron_rate"] == 20 and got["fps_explicit_ratio"] == 0.5 and got["fpp_rate"] == 20 and got["tps_rate"] == 20
    assert got["self_other_ratio"] == pytest.approx(3 / 4)


def test_homographs_need_their_part_of_speech(spark):
    got = extract(spark, [token("solo", pos="ADV"), token("solo", pos="ADJ"), token("como", pos="SCONJ"), token("preocuparme", "preocupar yo", "VERB")], blocks=("clinical",))
    assert got["clin_soledad"] == 25 and got["clin_apetito"] == 0 and got["clin_preocupacion"] == 25 and got["clin_total_rate"] == 50


def test_guarded_lemma_falls_through_to_the_form(spark):
    assert extract(spark, [token("cansada", "como", "ADJ")], blocks=("clinical",))["clin_energia"] == 100


def test_negation_and_discourse(spark):
    toks = [token("No", "no", "ADV", Polarity="Neg"), token("siempre", pos="ADV"), token("nada", pos="PRON"), token("pues", pos="ADV", sent=1), token("pues", pos="ADV", sent=1)]
    got = extract(spark, toks, "No siempre nada... Pues pues", 2, ("negation", "discourse"))
    assert got["negation_rate"] == 40 and got["absolutist_rate"] == 40 and got["absolutist_coverage"] == pytest.approx(2 / 19)
    assert got["neg_per_sentence"] == 1 and got["hesitation_rate"] == 20 and got["repetition_rate"] == 20
    assert got["mean_sentence_len"] == 2.5 and got["sentence_len_sd"] == 0.5 and got["discourse_marker_rate"] == 40


def test_morphosyntax(spark):
    toks = [token("quería", "querer", "VERB", VerbForm="Fin", Tense="Imp"), token("fue", "ser", "AUX", VerbForm="Fin", Tense="Past"), token("duerma", "dormir", "VERB", VerbForm="Fin", Mood="Sub", Tense="Pres"), token("muy", pos="ADV")]
    got = extract(spark, toks, "hay que dormir", 1, ("morphosyntax",))
    assert got["pos_verb_rate"] == 75 and got["tense_past_rate"] == 25 and got["mood_subjunctive_rate"] == 25 and got["modal_rate"] == 50 and got["intensifier_rate"] == 25


@pytest.mark.parametrize("text", ["", "   ", "Sí.", "...", "[LUGAR]", "mmm", "No."])
def test_degenerate_answers_are_finite(spark, text):
    df = ft.annotate(spark.createDataFrame([(text,)], "text string"), "text")
    tagged = df.withColumn("tokens", F.transform("tokens", lambda t: t.withField("pos", F.lit("NOUN"))))
    got = ft.extract(tagged).first().asDict()
    assert list(got) == ft.feature_names() and all(v is not None and abs(v) < 1e6 and v == v for v in got.values())
    if not df.first()["tokens"]:
        assert got["fernandez_huerta"] == pytest.approx(206.84)


def test_blocks_that_need_tags_refuse_untagged_answers(spark):
    df = ft.annotate(spark.createDataFrame([("Hola a todos.",)], "text string"), "text")
    with pytest.raises(ft.NeedsTags):
        ft.extract(df)
    assert ft.extract(df, ("negation", "discourse")).first()["absolutist_rate"] == pytest.approx(100 / 3)


def test_doubling_a_text_leaves_rates_unchanged(spark):
    text = "No sé qué decir. Siempre estoy muy cansada, pues nada."
    two = [ft.extract(ft.annotate(spark.createDataFrame([(t,)], "text string"), "text"), ("negation", "discourse")).first().asDict() for t in (text, f"{text} {text}")]
    for k in ("negation_rate", "absolutist_rate", "absolutist_coverage", "neg_per_sentence", "discourse_marker_rate", "mean_sentence_len"):
        assert two[0][k] == pytest.approx(two[1][k]), k


def test_affect(spark):
    norms = spark.createDataFrame([("triste", 2.0, 4.0, "ADJECTIVE", 1.0, 2.0, 2.5, 3.0, 4.5), ("fiesta", 8.0, 7.0, "NOUN", 4.8, 1.0, 1.0, 1.0, 1.0), ("sol", 7.0, 5.0, None, None, None, None, None, None)], "key string, valence double, arousal double, dominant_pos string, " + ", ".join(f"{e} double" for e in lex.EMOTIONS))
    df = answers(spark, ("", [token("triste", pos="ADJ"), token("Fiesta", "fiesta"), token("sol"), token("triste", pos="NOUN"), token("de", pos="ADP")], 1), ("", [], 1))
    got = {r["id"]: r for r in ft.affect(df, norms, ["id"]).collect()}
    a = got[0]
    assert a["val_mean"] == pytest.approx(17 / 3) and a["val_min"] == 2 and a["val_low_rate"] == pytest.approx(1 / 3) and a["val_high_rate"] == pytest.approx(2 / 3)
    assert a["affect_coverage"] == 0.75 and a["emo_coverage"] == 0.5 and a["emo_fear_max"] == 3.0
    b = got[1]
    assert (b["val_mean"], b["aro_max"], b["emo_fear_mean"], b["val_sd"], b["affect_coverage"]) == (5.0, 5.0, 1.0, 0.0, 0.0)


def test_entities_without_answers_are_zero(spark):
    a = spark.createDataFrame([("p", 1.0, 2.0), ("p", 3.0, 4.0)], "e string, f double, n double")
    got = {r["e"]: r for r in ft.per_entity(a, spark.createDataFrame([("p",), ("q",)], "e string"), "e", ["f"], ("f",), "n").collect()}
    assert (got["p"]["f"], got["p"]["f_sd"], got["p"]["n_words_total"], got["p"]["words_per_answer_sd"]) == (2.0, 1.0, 6.0, 1.0)
    assert all(v == 0 for k, v in got["q"].asDict().items() if k != "e")
