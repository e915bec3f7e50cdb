"""Taste clauses of rule texts in three languages, with hand-written results."""

import pytest

from quarry.operators import taste

FR = """CAHIER
X. - Lien avec la zone
2°- Informations sur la qualité et les caractéristiques du produit
Les vins blancs sont secs. Leur robe est pâle, avec des
arômes de fleurs et une belle fraîcheur en bouche.

Version n° 3 du texte
Production de 300 hectolitres.

Les vins rouges ont une robe rubis et
12 / 40
des tanins souples, un nez de fruits.

Ils gagnent en complexité avec la garde, et leur finale reste fraîche.

        Vins mousseux de qualité
La mousse est fine, les bulles persistantes et les arômes floraux.

3°- Interactions causales
Les vins rosés ont une robe saumon et un nez de fruits rouges, hors de la section.
Le titre alcoométrique volumique naturel minimum de 11,5 % pour les vins rouges, et
titre alcoométrique volumique naturel minimum de 10 % pour les vins blancs.
"""
IT = """Articolo 6
Il vino a denominazione di origine controllata «Colle» rosso riserva
deve rispondere, all'atto dell'immissione al consumo, alle seguenti caratteristiche:
- colore: rosso rubino tendente
al granato;
- odore: fine, etereo;

- sapore: da secco ad amabile, pieno;
- titolo alcolometrico volumico totale minimo: 12,50% vol;
- acidità totale minima: 4,5 g/l.
17

Colle bianco spumante
spuma: fine;
colore: giallo paglierino;
sapore: brut;

Una frase che finisce.
colore: rosa tenue;
odore: floreale
Articolo 7
"""
ES = """PLIEGO DE CONDICIONES
2. DESCRIPCIÓN
b) Características organolépticas
VINO TINTO RESERVA
Vista: rojo granate, capa
alta.
Olfato: fruta y madera.
Boca: seco, con taninos.
Vista: rojo teja.
Boca: equilibrado.
Vinos blancos:
Color amarillo pálido, aroma de flores y fruta, fresco en la entrada.
3. PRÁCTICAS ENOLÓGICAS ESPECÍFICAS
Vista: no pertenece.
Boca: tampoco.
"""
ES_PROSE = """Son vinos.
Descripción organoléptica de los vinos del lugar, con todas las palabras que hacen falta para no ser un título
Los vinos tintos tienen color cereza y sabor a fruta madura, con taninos
suaves.

Su aroma recuerda a las especias y a la madera nueva de la crianza.

Los vinos rosados son dulces, de color rosa y aroma de fresa y flores.
"""


def run(spark, lang, *texts):
    rows = taste.clauses(spark.createDataFrame([(i, lang, t) for i, t in enumerate(texts)], "doc long, lang string, text string")).orderBy("doc", "place").collect()
    return [tuple(r[c] for c in ("doc", "style", "style_key", "colour", "min_alcohol", "sweetness")) for r in rows], [r["clause"] for r in rows]


def test_french(spark):
    marks, texts = run(spark, "fr", FR, None, "", "sans section")
    assert marks == [(0, "vins blancs", "vins blancs", "white", 10.0, "dry"), (0, "vins rouges", "vins rouges", "red", 11.5, None), (0, "Vins mousseux de qualité", "vins mousseux de qualite", "sparkling", None, None)]
    assert texts[0] == "Les vins blancs sont secs. Leur robe est pâle, avec des arômes de fleurs et une belle fraîcheur en bouche."
    assert texts[1] == "Les vins rouges ont une robe rubis et des tanins souples, un nez de fruits.\nIls gagnent en complexité avec la garde, et leur finale reste fraîche."
    assert texts[2] == "La mousse est fine, les bulles persistantes et les arômes floraux."


def test_french_alcohol(spark):
    """One figure for all counts for every clause; several without a colour count for none."""
    body = "x\nSpécificité du produit\nLes vins rouges ont une robe rubis et des tanins souples, un nez de fruits.\n"
    one, two = ("Le titre alcoométrique volumique naturel minimum de %s %%. " % v for v in ("11", "12"))
    assert [m[4] for m in run(spark, "fr", body + one)[0]] == [11.0]
    assert [m[4] for m in run(spark, "fr", body + one + two)[0]] == [None]
    assert [m[4] for m in run(spark, "fr", body + one.replace("11", "40"))[0]] == [None]


def test_italian(spark):
    marks, texts = run(spark, "it", IT)
    assert marks == [(0, "Colle rosso riserva", "colle rosso riserva", "red", 12.5, "dry to medium-sweet"), (0, "Colle bianco spumante", "colle bianco spumante", "sparkling", None, "brut"), (0, None, "all", "rose", None, None)]
    assert texts[0].split("\n") == ["- colore: rosso rubino tendente al granato;", "- odore: fine, etereo;", "- sapore: da secco ad amabile, pieno;", "- titolo alcolometrico volumico totale minimo: 12,50% vol;", "- acidità totale minima: 4,5 g/l."]
    assert texts[1] == "spuma: fine;\ncolore: giallo paglierino;\nsapore: brut;" and texts[2] == "colore: rosa tenue;\nodore: floreale"


def test_repeats(spark):
    """The same block of one style is one clause; another text of the style has a number."""
    block = "Rosso\ncolore: rosso;\nsapore: %s;\n\n"
    marks, _ = run(spark, "it", "x\n" + block % "secco" + block % "dolce" + block % "secco")
    assert [m[2] for m in marks] == ["rosso", "rosso 2"] and [m[5] for m in marks] == ["dry", "sweet"]


def test_spanish(spark):
    marks, texts = run(spark, "es", ES)
    assert marks[0] == (0, "VINO TINTO RESERVA", "vino tinto reserva", "red", None, "dry") and marks[2][1:4] == ("Vinos blancos", "vinos blancos", "white") and len(marks) == 3
    assert texts == ["Vista: rojo granate, capa alta.\nOlfato: fruta y madera.\nBoca: seco, con taninos.", "Vista: rojo teja.\nBoca: equilibrado.", "Color amarillo pálido, aroma de flores y fruta, fresco en la entrada."]
    marks, texts = run(spark, "es", ES_PROSE)
    assert [m[1:4] for m in marks] == [("vinos tintos", "vinos tintos", "red"), ("vinos rosados", "vinos rosados", "rose")] and [m[5] for m in marks] == [None, "sweet"]
    assert texts[0].endswith("\nSu aroma recuerda a las especias y a la madera nueva de la crianza.")


@pytest.mark.parametrize("lang", ["fr", "it", "es", "de"])
def test_edges(spark, lang):
    assert run(spark, lang, None, "", "\n\n", "colore", "Vista") == ([], [])
