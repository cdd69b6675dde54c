from __future__ import annotations

import pytest

from tessera.llm import quality

PROSE = {
    "en": "The crew measured the wall of the riser in March, and the loss was larger than in the year before.\nIt is not clear whether the method would hold at low temperature.",
    "de": "Der Betreiber in Wouzos hat die Werte nach der Kalibrierung gemessen, und sie waren nicht besser als im Jahr davor.",
    "fr": "L'exploitant a indiqué que le survol par drone avait réduit la durée de contrôle, mais seulement pendant la nuit.",
    "es": "Después de la parada en Trodex, la duración de la inspección de las bombas era más alta que en el año anterior.",
    "wrapped": "Neither the panel nor the owners could agree\nabout what caused the failure of the rotor shaft\nbefore the plant was opened again. As of August\nthe status of the cooling tower was still under\nreview, and it is not known when it will end.",
    "lower": "crew 16 of the works increased the detection probability by 24 percent on 434 rail joints and then it left for the coast",
    "with_list": "The following parts were ordered after the inspection, because they had been damaged by the fire in the second hall.\n- valve\n- riser\n- pump",
}
OTHER = {
    "bullets": "Checklist\n- corroded hull plate\n- coverage of the unpainted bridge cable from the works\n- rework share: 53\n- coated riser",
    "plain_list": "Spare parts\n\nlined penstock\nnotes on the riser and on laser shearography\naged pump\nrepeat variance: 13\ncoated turbine",
    "pipes": "| a | b |\n|---|---|\n| 2995 | valve body |\n| flange | 3695 |",
    "csv": "2840,7915,2025-11-03,riser\n2006-02-07,n/a,pump,rotor shaft\n52.89,2024-09-27,62,68.13",
    "html": "<tr><td>gearbox</td><td>2415</td></tr>\n<tr><td>45.24</td><td>36.15</td></tr>",
    "spam": "buy pressure vessel cheap girth weld best acoustic emission top boiler tube buy storage tank cheap pump",
    "menu": "Downloads » Imprint » Home » Login » Back to top » Search",
    "base64": "I2WeowJopl2bnpr9vOD+swxesd5GWOaaVUi44IZGXbxvSJzVsyzvMivuoPFzsPqN\niTmdj+Nh1t7VrTvavatH3oEO8mfHkoQrwEQCuDHNSzb0OKbs+/yTjXpoWTHAijuQ",
    "code": "    if row[5] = [];\nself.store node_ids[3] == None;\n    def node_ids[4] += None;",
    "garbled": "ÂÂ ãaâÂã€t dâ KÃeva§Â€ãÃves¶a ét©Ãcom¤létã paœ €r¤ãÃãâãœ§ Drive�¶¶Ã¤ €eÃ",
    "blank": " \n \t\n",
    "empty": "",
    "null": None,
}


@pytest.fixture(scope="module")
def judged(spark):
    names = [*PROSE, *OTHER]
    df = spark.createDataFrame([(i, {**PROSE, **OTHER}[n]) for i, n in enumerate(names)], "doc_id long, text string")
    return {names[r.doc_id]: r for r in quality.quality(df).collect()}


def test_prose_is_told_from_the_rest(judged):
    assert {n for n, r in judged.items() if r.is_prose} == set(PROSE)


def test_labels_and_reasons(judged):
    assert judged["bullets"].label == "list" and "list" in judged["bullets"].reasons
    assert judged["pipes"].label == "table" and judged["html"].label == "table"
    assert judged["menu"].label == "table" or judged["menu"].label == "junk"
    assert judged["base64"].reasons[0] == "word_length" and "short_lines" in judged["plain_list"].remarks
    assert judged["with_list"].remarks == ["word_count", "short_lines"] and "word_count" in judged["de"].remarks
    assert judged["base64"].label == "junk" and judged["blank"].reasons == ["blank"] and judged["null"].reasons == ["blank"]
    assert all(bool(r.reasons) != r.is_prose and (r.label == "prose") == r.is_prose for r in judged.values())


def test_statistics(spark):
    df = spark.createDataFrame([(1, "The pump failed.\n\nIt was old"), (1, "The pump failed.\n\nIt was old"), (None, "x")], "doc_id long, text string")
    got = quality.quality(df.selectExpr("*", "1 as lines", "2 as chars", "3 as m")).where("doc_id = 1").collect()
    assert len(got) == 2 and got[0].words == 6
    assert got[0].mean_word_length == round(21 / 6, 6) and got[0].symbol_ratio == round(1 / 6, 6)
    assert got[0].closed_line_share == 0.5 and got[0].common_word_share == round(3 / 6, 6)
    assert quality.not_prose(df.limit(0)).count() == 0


def test_a_very_long_text(spark):
    df = spark.createDataFrame([(1, (PROSE["en"] + "\n") * 3000)], "doc_id long, text string")
    assert quality.quality(df).first().is_prose
