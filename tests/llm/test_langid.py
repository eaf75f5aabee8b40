import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import langid as g
from tallyframe.llm.sentences import tagger

HELD_OUT = {
    "es": "Mañana tengo que llamar a mi hermano. No quiero salir de la casa esta semana.", "en": "Tomorrow I have to call my brother. I would rather stay at home this week.", "pt": "Amanhã tenho que ligar para o meu irmão. Não quero sair de casa esta semana.",
    "ca": "Demà he de trucar al meu germà. No vull sortir de casa aquesta setmana.", "fr": "Demain je dois appeler mon frère. Je ne veux pas sortir de la maison cette semaine.", "it": "Domani devo chiamare mio fratello. Non voglio uscire di casa questa settimana.",
    "de": "Morgen muss ich meinen Bruder anrufen. Ich will diese Woche nicht aus dem Haus gehen.", "ru": "Завтра мне нужно позвонить брату. Я не хочу выходить из дома.", "zh": "明天我要给哥哥打电话。这个星期我不想出门。", "ja": "明日、兄に電話しなければなりません。今週は家にいたいです。",
    "ar": "غدا يجب أن أتصل بأخي. لا أريد الخروج من البيت.", "hi": "कल मुझे अपने भाई को फ़ोन करना है। मैं घर से बाहर नहीं जाना चाहता।", "th": "พรุ่งนี้ฉันต้องโทรหาพี่ชาย ฉันไม่อยากออกจากบ้าน",
}


@pytest.fixture(scope="module")
def net():
    return g.train([], tagger())


def test_held_out_languages(net):
    """Trained on the seed texts alone; each held-out text gets its language from its windows."""
    right = 0
    for lang, text in HELD_OUT.items():
        right += g.LANGS[int(net.log_probs(g.matrix(g.windows(g.clean(text)))).mean(0).argmax())] == lang
    assert right >= 11


def test_gradients_follow_the_loss():
    net = g.ByteNet(dim=4, filters=6, seed=1)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (64, g.WINDOW)).astype(np.uint8), rng.integers(0, 13, 64)
    before = -net.log_probs(x)[np.arange(64), y].mean()
    for _ in range(12):
        net.fit(x, y, 4, rate=0.02)
    assert -net.log_probs(x)[np.arange(64), y].mean() < 0.8 * before


def test_windows_cover_the_text():
    raw = ("ñandú " * 100).strip()
    assert len(g.windows(raw)) == -(-len(raw.encode()) // g.WINDOW) and all(len(w) == g.WINDOW for w in g.windows(raw))
    assert g.windows("") == [b""]


@pytest.mark.parametrize("label,want", [("ES", "es"), ("es-CO", "es"), ("pt_BR", "pt"), ("spa", "es"), (" und ", None), ("", None), (None, None), ("unknown", None), ("nl", "nl"), ("ENG", "en")])
def test_codes(spark, label, want):
    assert spark.range(1).select(g.code_of(F.lit(label).cast("string"))).first()[0] == want


def run(spans_langs, counts=None):
    scores = np.full((len(spans_langs), len(g.LANGS)), -9.0)
    for i, lang in enumerate(spans_langs):
        scores[i, g.LANGS.index(lang)] = -0.01
    letters = np.array(counts or [40.0] * len(spans_langs), dtype=float)
    return [(g.LANGS[r[2]], r[4]) for r in g.segment([(10 * i, 10 * i + 9) for i in range(len(spans_langs))], letters, scores)]


def test_two_neighbouring_sentences_make_a_segment():
    assert run(["es", "es", "fr", "fr", "es", "es"]) == [("es", 2), ("fr", 2), ("es", 2)]
    assert run(["es", "es", "fr", "es", "es"]) == [("es", 5)]
    assert run(["es", "es", "fr"]) == [("es", 3)]
    assert run(["fr", "es", "es"]) == [("es", 3)]
    assert run(["es", "fr"], [60, 20]) == [("es", 2)]
    assert run(["fr"]) == [("fr", 1)]


def test_quotations_and_tags_do_not_count():
    assert "burnout" not in g.clean('Estoy en modo "burnout" total desde ayer')
    assert g.clean("#ánimo [NOMBRE] <b> 123 hola") == "hola"
    assert "basta" in g.clean('"¡Ya basta!"')


def test_operator(spark, net):
    mixed = HELD_OUT["zh"] + "\n" + HELD_OUT["ru"]
    rows = [(1, HELD_OUT["ru"], "es"), (2, HELD_OUT["ru"], "RU"), (3, HELD_OUT["th"], None), (4, None, None), (5, "12/27 – 9", "und"), (6, mixed, "zh"), (1, HELD_OUT["ru"], "es"), (7, HELD_OUT["ja"] * 300, "jpn")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"ident": F.lit(1), "label": F.lit("x"), "code": F.lit("y")})
    segments = g.identify(df, net)
    assert {tuple(r) for r in g.doubtful(segments).collect()} == {(1, "ru"), (3, "th"), (6, "zh"), (6, "ru")}
    assert segments.where("confidence < 0 or confidence > 1").count() == 0
    assert g.doubtful(g.identify(df.where("false"), net)).count() == 0
    assert g.fit_on(df.where("false")) is not None
