"""The model of addresses on hosts that its table doesn't hold."""

import pytest

from strophe.llm import url_filter

ORDINARY = """thernd tionsh ththbook rerest onword ingham schlossgarten boulangerie patisserie lecture geology
planets telescope carpentry violin orchestra gallery monument senate parliament weaving pottery orchard meadow
lighthouse vineyard chess puzzle grammar algebra history-of-art sailing-club birdwatch recipes glacier volcano
""".split()
UNWANTED = """best-casino online-poker win-free-bets cheap-viagra pillshop adult-x xxxmovies camsex spam-farm
ads-track trackerads freeloans jackpot-city warezworld crackz gambling-tips porn-hd bettingpro pokerstar
escorts-now pharma-cheap spamlist""".split()


@pytest.fixture(scope="module")
def judged(spark):
    hosts = [(h, 0) for h in ORDINARY] + [(h, 1) for h in UNWANTED]
    pages = [
        (k, f"http://{lead}{host}.example.{end}/{lang}/{3 * i + 1001}{tail}", label)
        for k, (i, (host, label), (lead, end, lang, tail)) in enumerate(
            (i, pair, form)
            for i, pair in enumerate(hosts)
            for form in (("", "net", "en", ""), ("www.", "com", "es", ".html"), ("m.", "net", "fr", "/"))
        )
    ]
    table = spark.createDataFrame(url_filter.labelled_addresses(), "url string, label int")
    known = {url.split("://")[1].split("/")[0] for url, _ in url_filter.labelled_addresses()}
    assert not any(u.split("://")[1].split("/")[0] in known for _, u, _ in pages)
    frame = spark.createDataFrame([p[:2] for p in pages], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(frame, table, rules=()).collect()}
    return [(got[k].score, got[k].verdict, label) for k, _, label in pages]


def test_held_out_hosts_are_told_apart(judged):
    good, bad = ([s for s, _, y in judged if y == label] for label in (0, 1))
    wins = sum((b > g) + 0.5 * (b == g) for b in bad for g in good)
    assert wins / (len(good) * len(bad)) > 0.9


def test_ordinary_hosts_are_rarely_blocked(judged):
    blocked = [v == "block" for _, v, y in judged if y == 0]
    assert sum(blocked) / len(blocked) < 0.1
    caught = [v == "block" for _, v, y in judged if y == 1]
    assert sum(caught) / len(caught) > 0.7


def test_given_pages_are_judged_by_their_words(spark):
    """Ordinary hosts of the table pass where no rule speaks."""
    got = url_filter.op5_url_filter(spark, "/root/testdata/sf0.01").where("rule IS NULL").collect()
    words = ("casino", "bets", "pills", "adult", "spam", "ads", "win")
    plain = [r for r in got if r.host and not any(w in r.host for w in words)]
    odd = [r for r in got if any(w in r.host for w in words)]
    assert sum(r.verdict == "block" for r in plain) < 0.1 * len(plain)
    assert sum(r.verdict == "block" for r in odd) > 0.9 * len(odd)


def test_empty_table(spark):
    table = spark.createDataFrame(url_filter.labelled_addresses(), "url string, label int")
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), table).count() == 0
