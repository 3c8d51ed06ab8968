"""Times and windows asked for; authentication headers."""

from datetime import datetime, timedelta, timezone

import pytest

from almanak.functions.headers import authentication, first_header, verdicts
from almanak.plans.windows import LONGEST, listing_window, read_time, search_window

NOW = datetime(2027, 1, 20, 15, tzinfo=timezone.utc)
DAY = timedelta(days=1)


def test_times_with_an_offset():
    assert read_time(" 2027-01-20T20:30:00+05:30 ") == read_time("2027-01-20t15:00Z") == NOW and read_time("2027-01-20 15:00:00.5z") == NOW + timedelta(milliseconds=500)


def test_times_of_a_zone():
    at = lambda text, zone: read_time(text, zone).strftime("%d %H:%M")
    assert at("2027-07-01T08:00", "Asia/Tokyo") == "30 23:00" and at("2027-07-01", "America/Halifax") == "01 03:00"
    # clocks in Halifax: 14 March 2027 skips 02:00 to 03:00, 7 November repeats 01:00 to 02:00
    assert at("2027-03-14T02:15", "America/Halifax") == "14 06:15" and at("2027-11-07T01:15", "America/Halifax") == "07 04:15"


@pytest.mark.parametrize("text", ["", "now", "2027-02-29", "2027-1-2", "20270120", "2027-01-20T25:00", "1899-12-31", "2201-01-01"])
def test_no_times(text):
    with pytest.raises(ValueError):
        read_time(text)


def test_windows():
    assert listing_window(None, None, NOW) == (NOW, NOW + 7 * DAY) and listing_window(NOW - DAY, None, NOW) == (NOW - DAY, NOW + 6 * DAY) and listing_window(None, NOW + DAY, NOW)[1] == NOW + DAY
    assert search_window(None, None, NOW) == (NOW - 90 * DAY, NOW + 275 * DAY) and search_window(None, NOW, NOW) == (NOW - 365 * DAY, NOW) and search_window(NOW, None, NOW) == (NOW, NOW + 365 * DAY)
    assert search_window(NOW, NOW + LONGEST, NOW)[1] == NOW + LONGEST
    for a, b in ((NOW, NOW), (NOW, NOW - DAY), (NOW, NOW + LONGEST + DAY)):
        with pytest.raises(ValueError):
            listing_window(a, b, NOW)


def test_the_topmost_header_counts():
    block = "Received: x\nauthentication-results: relay.town.test;\n\tspf=pass\n  smtp.mailfrom=town.test\nAuthentication-Results: elsewhere.test; spf=fail\n"
    assert first_header(block, "Authentication-Results") == "relay.town.test; spf=pass smtp.mailfrom=town.test" and first_header(block, "Subject") is None


def test_verdicts(spark):
    blocks = ["Authentication-Results: relay.town.test;\n spf=pass (sender is fine) smtp.mailfrom=town.test;\n iprev=pass; DMARC=None header.from=Town.test\n", "Authentication-Results: relay.town.test; none\n", "To: eva\n", "", None]
    got = [r[0] for r in spark.createDataFrame([(b,) for b in blocks], "b string").select(authentication("b")).collect()]
    assert got == ["spf=pass (smtp.mailfrom=town.test); dmarc=none (header.from=Town.test); by relay.town.test", "no spf, dkim or dmarc result; by relay.town.test", None, None, None]
    assert verdicts("; dkim=temperror") == "dkim=temperror" and verdicts("r.test; dkim=pass (1024 (old) bits) header.i=@a.test header.d=a.test") == "dkim=pass (header.d=a.test); by r.test"
