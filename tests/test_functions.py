"""Column helpers."""

import random

from pyspark.sql import functions as F

from riskboard.functions import labels, text
from riskboard.operators import pages, privacy, tasks


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_defaults(spark):
    null = F.lit(None).cast("string")
    assert one(spark, text.first_filled(F.lit(""), null, F.lit("x"))) == "x"
    assert one(spark, text.trim_all(F.lit("　 a b﻿\n"))) == "a b"
    assert one(spark, text.is_blank(F.lit(" 　\t"))) and one(spark, text.is_blank(null))
    assert not one(spark, text.is_blank(F.lit(" .")))
    assert one(spark, text.number_or_zero(F.lit("7.5"))) == 7.5
    assert one(spark, text.number_or_zero(F.lit("x"))) == 0.0
    assert one(spark, text.round_half_up(F.lit(96.5))) == 97
    assert one(spark, text.round_half_up(F.lit(-0.5))) == 0
    assert one(spark, text.norm_name(F.lit(" Au-Rum　Ltd. "))) == "aurumltd"


def test_labels(spark):
    assert one(spark, labels.label("phase", F.lit("OCR"))) == "图片文字识别"
    assert one(spark, labels.label("phase", F.lit("NEW"))) == "NEW"
    assert one(spark, labels.label("phase", F.lit(""))) == "其他"
    assert one(spark, labels.label("phase", F.lit(None).cast("string"))) == "其他"
    risk = lambda v: labels.verdict_label(F.lit(v).cast("boolean"))
    assert [one(spark, risk(v)) for v in (True, False, None)] == ["有风险", "未发现", "待判定"]
    stage = lambda s, p: one(spark, labels.stage_shown(F.lit(s), F.lit(p).cast("string")))
    assert stage("CLOSED", "OCR") == "已完成" and stage("OPEN", "OCR") == "图片文字识别"
    assert {stage("OPEN", p) for p in ("-", "待判定", None, "")} == {"待判定"}
    assert [one(spark, labels.evidence_label(F.lit(g))) for g in ("verified", "partial", "x")] == [
        "已验证", "部分/仅摘录", "数据缺失"]


def test_hosts(spark):
    host = text.host_of(F.lit("HTTPS://Blog.One.example.com:80/a?b#c"))
    assert one(spark, host) == "blog.one.example.com"
    assert one(spark, text.domain_of(host)) == "one.example.com"
    assert one(spark, text.site_label(host)) == "one"
    assert one(spark, text.host_of(F.lit("https://user:pw@host.example.com:1/x"))) == "host.example.com"


def test_indented_json(spark):
    m = F.create_map(F.lit("a"), F.lit('x"y'), F.lit("b"), F.lit(None).cast("string"))
    assert one(spark, text.indented_json(m)) == '{\n  "a": "x\\"y",\n  "b": null\n}'


def test_task_card_cuts_at_1000(spark):
    df = spark.range(1).select(F.lit("OK").alias("status"), F.lit("").alias("task_dir"),
                               F.create_map(F.lit("k"), F.repeat(F.lit("z"), 3000)).alias("summary"))
    row = tasks.task_cards(df).first()
    assert row["title"] == "未命名任务" and row["status_label"] == "成功" and len(row["detail"]) == 1000


def test_mask(spark):
    got = one(spark, privacy.mask(F.lit("a.b@c.example.com +1 (743) 555-3824 10.0.0.1 4785380592391139 ok")))
    assert got == "[MAIL] [PHONE] [ADDR] [ID] ok"
    assert one(spark, privacy.mask(F.lit(None).cast("string"))) is None


def test_mask_leaves_no_personal_data(spark):
    for raw in ("138-0013-8000", "138 0013 8000", "13800138000", "010-12345678", "张三@例子.中国", "11010119900307123X",
                "+86 138-0013-8000", "a" * 80 + "@x.com", "138.0013.8000", "(010)12345678", "(010) 1234-5678", "（010）12345678",
                "021-1234 5678", "１３８００１３８０００", "a＠b.com", "2001:db8::1", "fe80::1:2:3", "2001:0db8:0:0:0:ff00:42:8329",
                "13800138000x", "4111 1111 1111 1111", "4111-1111-1111-1111", "6222 0212 3456 7890 128", "11010519491231002X",
                "110105 19491231 002X", "1101051949123100２Ｘ"):
        got = one(spark, privacy.mask(F.lit(f"<{raw}>")))
        assert got in ("<[MAIL]>", "<[PHONE]>", "<[ID]>", "<[ADDR]>"), (raw, got)


def test_mask_leaves_ordinary_numbers(spark):
    for raw in ("4111 1111 1111 1112", "1234 5678 9012", "in 2019 and 2020, 12 of 345", "12:30:45", "std::vector", "3.14159 2.71828", "v1.2.3", "1 000 000"):
        assert one(spark, privacy.mask(F.lit(f"<{raw}>"))) == f"<{raw}>"


def test_check_digits(spark):
    rnd, cards, names = random.Random(4), [], []
    for _ in range(60):
        card = [rnd.randrange(10) for _ in range(rnd.randrange(12, 19))]
        double = [sum(divmod(2 * d, 10)) if k % 2 == 0 else d for k, d in enumerate(reversed(card))]
        good = "".join(map(str, card)) + str(-sum(double) % 10)
        other = good[:-1] + str((int(good[-1]) + 1) % 10)
        cards += [(good, True), (other, False)]
        own = [rnd.randrange(10) for _ in range(17)]
        last = "10X98765432"[sum(d * w for d, w in zip(own, (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2))) % 11]
        name = "".join(map(str, own))
        names += [(name + last, True), (name + ("1" if last != "1" else "2"), False)]
    for rows, valid in ((cards, privacy.valid_card), (names, privacy.valid_identity)):
        got = spark.createDataFrame(rows, "n string, want boolean").select("want", valid(F.col("n")).alias("got"))
        assert got.filter("want <> got or got is null").count() == 0


def test_links_in_all_forms(spark):
    html = "<a href='/a?x=1&amp;y=2'>1</a><a class=k href=/b>2</a><A HREF = \"/c&#x2F;d&#47;\">3</A><a data-href=/no>4</a>"
    df = spark.createDataFrame([(1, "http://h.example/", html)], "page_id long, url string, html string")
    assert [r["href"] for r in pages.page_links(df).collect()] == ["/a?x=1&y=2", "/b", "/c/d/"]
    assert one(spark, pages.decoded(F.lit("&#20445;&#x672C; &#x1F600;&#0;&#55296; &amp;"))) == "保本 \U0001f600&#0;&#55296; &"
    more = "&eacute;&euro;&hellip; &#38;lt; &amp;lt; &apos; &nosuch; & &; &AMP; x&lt"
    assert one(spark, pages.decoded(F.lit(more))) == "é€… &lt; &lt; ' &nosuch; & &; &AMP; x&lt"
    html = "<!-- <a href=/no>n</a> --><map><area shape=rect href='/area'></map><a href=/x>y</a><!-- <a href=/un"
    df = spark.createDataFrame([(1, "http://h.example/", html)], "page_id long, url string, html string")
    assert [r["href"] for r in pages.page_links(df).collect()] == ["/area", "/x", "/un"]


def test_missing_summary_is_an_empty_card(spark):
    df = spark.range(1).select(F.lit("OK").alias("status"), F.lit("x").alias("task_dir"),
                               F.lit(None).cast("map<string,string>").alias("summary"))
    assert tasks.task_cards(df).first()["detail"] == "{}"


def test_page(spark):
    html = ('<html><head><title> A &amp; B </title></head><body><script>var x="<p>";</script>'
            '<p>one</p><!-- no --><a class=k HREF="/x">two</a>&lt;</body>')
    df = spark.createDataFrame([(1, "http://www.h.example/", html)], "page_id long, url string, html string")
    row = pages.page_text(df).first()
    assert (row["host"], row["title"], row["text"]) == ("www.h.example", "A & B", "one two <")
    assert [tuple(r) for r in pages.page_links(df).collect()] == [(1, 0, "/x")]


def test_task_stats_terminal_is_finished(spark, rows):
    done = lambda c, **odd: [(c, i, odd.get(f"p{i}", "OK")) for i in range(12)]
    df = spark.createDataFrame(
        done(1) + [(2, 0, "OK"), (2, 1, "TERMINAL"), (2, 2, "FAILED")] + done(3, p11="TERMINAL")
        + done(4, p3="FAILED") + done(5, p4="TERMINAL") + [(6, 11, "OK")] + done(7) + [(7, 4, "RUNNING")],
        "company_id long, phase_idx int, status string")
    assert rows(tasks.company_task_stats(df)) == [
        (1, 12, 12, 0, 0, "-", True, True), (2, 3, 1, 1, 0, "IMAGE_DOWNLOAD", False, False),
        (3, 12, 11, 0, 0, "-", True, True), (4, 12, 11, 1, 0, "OCR", False, True),
        (5, 12, 11, 0, 0, "-", True, False), (6, 1, 1, 0, 0, "WEB_ICP", False, False),
        (7, 13, 12, 0, 1, "KEYWORD", False, False)]


def test_two_tasks_of_a_phase_are_two(spark, rows):
    df = spark.createDataFrame(
        [(1, 1, 4, "K/a", "FAILED", None, 1), (2, 1, 4, "K/b", "OK", None, 2), (3, 1, 4, "K/a", "RETRY_WAIT", None, 3)],
        "event_id long, company_id long, phase_idx int, task_dir string, status string, error_code string, ts int")
    assert rows(tasks.task_state(df), "task_dir", "status", "attempts") == [("K/a", "RETRY_WAIT", 2), ("K/b", "OK", 0)]
