import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import pii, pii_seed
from tallyframe.llm.boosting import Boosted

GIVEN = ["Lorena", "Julián", "Rosa", "Sol", "Abril", "Camilo"]


@pytest.fixture(scope="module")
def finder():
    models, odds = pii.models_for(GIVEN)
    return pii.Finder(models, odds, pii.Lexicon(GIVEN), pii.Evidence())


CASES = [
    ("Mi correo es ana.perez@mail.test, gracias.", {("email", 13)}),
    ("Escriba a luz punto paz arroba uni punto example hoy.", {("email", 10)}),
    ("Es pepe21 [at] correo [dot] net siempre.", {("email", 3)}),
    ("El celular de mi mamá es +57 391 555 0125.", {("phone", 25)}),
    ("Estuve llamando al (609) 555-0113 toda la noche.", {("phone", 19)}),
    ("El celular es tres nueve cero cinco cinco cinco cero uno cero cinco.", {("phone", 14)}),
    ("电话号码是+1 415 555 0106，谢谢。", {("phone", 5)}),
    ("Mi cédula es 9.936.982.555, ya la di.", {("id_number", 13)}),
    ("El DNI XA817175 estaba vencido.", {("id_number", 7)}),
    ("Firmé con 99078646-R en la hoja.", {("id_number", 10)}),
    ("Vivo en Cra. 63 No. 13-48, apto. 302, por favor.", {("address", 8)}),
    ("I live at 70 Quinto Rd., next to a bakery.", {("address", 10)}),
    ("Ich wohne in der Birkenstraße 130, hier.", {("address", 17)}),
    ("Terminé con Lorena Gorscal hace un mes.", {("name", 12)}),
    ("Soy Camilo, documento 9968607086, y vivo en Carrera 60 con calle 86 desde enero.", {("name", 4), ("id_number", 22), ("address", 44)}),
]


@pytest.mark.parametrize("text,want", CASES)
def test_known_mentions(finder, text, want):
    assert {(k, a) for a, _, k, _ in finder.mentions([text])[0]} == want


@pytest.mark.parametrize("text", [
    "Rosa era el color de la pared.", "Sol y brisa en la cancha.", "Abril fue el mes más largo.", "Vivo por la calle principal.", "La Carrera de Psicología exige cuatro prácticas.", "Gasté $1.250.000 en medicinas.", "Guardé 1.020.000 pesos.",
    "Empezó el 12.03.2024 en la sede.", "El Dr. [NOMBRE] me vio en [LUGAR].", "El formulario 300-14 y el turno 0555 no aparecían.", "Entre 2019 y 2023 perdí cuatro materias.", "", "   ", "[NOMBRE]",
])
def test_no_mentions(finder, text):
    assert finder.mentions([text])[0] == []


def test_held_out_sentences(finder):
    """Composed with another seed: recall and precision of kind and start."""
    rng = random.Random(77)
    docs = [pii_seed.compose(rng, GIVEN) for _ in range(400)]
    hit = said = true = 0
    for (_, gold), found in zip(docs, finder.mentions([t for t, _ in docs])):
        want, got = {(k, a) for k, a, _ in gold}, {(k, a) for a, _, k, _ in found}
        hit, said, true = hit + len(want & got), said + len(got), true + len(want)
    assert hit / true > 0.9 and hit / said > 0.93


def test_hard_texts_take_proportional_time(finder):
    for hard in ("je" * 60_000, "1 " * 30_000, "@" * 30_000, "Calle " * 8_000, "uno " * 20_000, "[NOMBRE] " * 8_000):
        finder.mentions([hard])


def test_boosting_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)
    model = Boosted(rounds=40).fit(x, y)
    assert ((model.probability(x) >= model.threshold) == y).mean() > 0.95
    assert model.probability(np.zeros((0, 4))).shape == (0,)


def test_operators(spark):
    names = spark.createDataFrame([(g,) for g in GIVEN] + [(None,)], "given_name string")
    df = spark.createDataFrame([(1, "Mi correo es ana@mail.test, y  ya."), (2, None), (3, ""), (1, "Mi correo es ana@mail.test, y  ya.")], "row_id long, text string").withColumns({"ident": F.lit("x"), "kind": F.lit("y")})
    assert {tuple(r) for r in pii.find_mentions(df, names).select("row_id", "kind", "char_start", "char_end").collect()} == {(1, "email", 13, 26)}
    assert {tuple(r) for r in pii.redact(df, names).collect()} == {(1, "Mi correo es [EMAIL], y  ya."), (2, None), (3, "")}
    assert pii.find_mentions(df.where("false"), names.where("false")).count() == 0


def test_given_names_are_refused_not_cut(spark, monkeypatch):
    monkeypatch.setattr(pii, "MOST_NAMES", 2)
    monkeypatch.setattr(pii, "models_for", lambda given: (given, None))
    monkeypatch.setattr(pii, "case_evidence", lambda df, text: pii.Evidence())
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "given_name string")
    assert pii._prepare(names("a"), names("b", "a", None, "b"), "given_name")[2] == ["a", "b"]
    with pytest.raises(ValueError):
        pii._prepare(names("a"), names("a", "b", "c"), "given_name")
