"""Charsets of bodies without one, and answers that cannot be read."""

import json

import pytest

from tidemill.plans import collect, spec
from tidemill.sources.charset import detected

#: Sentences written for this test, and codecs that have their characters.
SENTENCES = [
    ("新华社北京电，今年以来全国经济运行总体平稳，就业形势保持稳定。记者从有关部门了解到，下一阶段将继续加强校园舆情管理。", ("gb18030", "utf-8")),
    ("記者從有關部門了解到，今年以來全國經濟運行總體平穩，就業形勢保持穩定，下一階段將繼續加強管理。", ("big5", "gb18030", "utf-8")),
    ("今日の東京は晴れで、気温は二十度でした。カタカナとひらがなを含む文章です。新聞記者が取材しました。", ("shift_jis", "euc_jp", "utf-8")),
    ("오늘 서울의 날씨는 맑고 기온은 이십 도였습니다. 한국어 문장을 확인하는 시험입니다.", ("euc_kr", "utf-8")),
    ("Сегодня в Москве ясно, температура двадцать градусов. Это проверка русского текста.", ("cp1251", "koi8_r", "utf-8")),
    ("Über die Straße läuft ein großer Hund, der müde ist. Größe und Übermut tun selten gut.", ("cp1252", "mac_roman", "cp850", "utf-16-le", "utf-16-be", "utf-16")),
    ("L'été dernier, nous avons mangé à côté du marché; c'était très agréable, même en forêt.", ("cp1252", "mac_roman", "cp850", "utf-16-le")),
    ("El niño pidió más té, ¿verdad? Mañana habrá sesión, según el señor Núñez.", ("cp1252", "mac_roman", "cp850")),
]


@pytest.mark.parametrize("text, codecs", SENTENCES)
def test_sentences_come_back_from_every_codec(text, codecs):
    for codec in codecs:
        for form in (text, f"<html><body class='x'>{text}</body></html>", text * 50):
            assert detected(form.encode(codec))[1] == form, codec


def test_bodies_that_say_little():
    for word in ("标题", "校园舆情", "新闻", "北京", "记者报道", "关于安全"):
        assert detected(f'{{"title": "{word}"}}'.encode("gb18030"))[1] == f'{{"title": "{word}"}}'
    assert detected(b"") == ("utf-8-sig", "") and detected(b"plain")[1] == "plain" and detected(b"\xef\xbb\xbfx")[1] == "x"
    assert isinstance(detected(bytes(range(256)))[1], str) and detected(b"\xff")[1] and detected(b"a\x00b\x00c\x00")[1] == "abc"


def test_unreadable_answers_are_rows_with_an_error_and_stop_the_paging(spark, tmp_path):
    page = json.dumps({"status": "ok", "news": [{"title": f"t{i}", "description": "d"} for i in range(20)]})
    for keyword in ("a", "b", "c"):
        (tmp_path / keyword / "currents").mkdir(parents=True)
        for n in (1, 2, 3):
            (tmp_path / keyword / "currents" / f"0-{n}.json").write_text(page)
    (tmp_path / "b/currents/.0-2.json.crc").write_bytes(b"crc\0" + (512).to_bytes(4, "big") + b"wrong checksums" * 20)  # a file that cannot be read
    (tmp_path / "c/currents/0-1.json").write_text(page + " " * 5000)
    (tmp_path / "d/currents").mkdir(parents=True)
    (tmp_path / "d/currents/0-1.json").write_text("")  # no answer
    (tmp_path / "notes.txt").write_text("no answer")
    answers = collect.read_answers(spark, str(tmp_path), most_bytes=4000)
    (tmp_path / "a/currents/0-3.json").unlink()  # gone between listing and reading
    assert {(r["keyword"], r["page"]): r["error"] for r in answers.where("error IS NOT NULL").collect()} == {("c", 1): "too long", ("b", 2): "unreadable"}
    assert answers.count() == 8
    assert {(r["keyword"], r["failed"]) for r in collect.failures(answers).collect()} == {("b", 1), ("c", 1)}
    wanted = spec.CollectSpec(("a", "b", "c", "d"), 3, ("currents",))
    got = collect.platform_records(answers, spec.tasks(spark, wanted), wanted).groupBy("seq.keyword_ix").count().collect()
    assert {r[0]: r[1] for r in got} == {0: 40, 1: 20}
