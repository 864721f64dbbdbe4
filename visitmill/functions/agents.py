"""User agents: ordered rules from text to browser, system and device."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitmill.functions.bind import let
from visitmill.schema import BOT, DESKTOP, OTHER_DEVICE, PHONE, TABLET, UNKNOWN_BROWSER, UNKNOWN_OS

# Words of automatic clients, in lower case.
BOT_WORDS = [
    "bot/", "bot;", "bot ", "bot)", "bot-", "bot_", "bot.", "spider", "crawl", "slurp", "mediapartners",
    "facebookexternalhit", "bingpreview", "lighthouse", "pingdom", "uptimerobot", "yandeximages", "feedfetcher",
    "archive.org", "python-requests/", "scrapy", "ahrefs", "semrush", "dataprovider", "http://", "https://",
]

# The first entry with all its words in the text names the browser.
BROWSERS = [
    (["Opera Mini"], "Opera Mini"),
    (["OPT/"], "Opera Touch"),
    (["OPR/"], "Opera"),
    (["OPiOS/"], "Opera"),
    (["Opera"], "Opera"),
    (["Edg/"], "Edge"),
    (["Edge/"], "Edge"),
    (["EdgA/"], "Edge"),
    (["EdgiOS/"], "Edge"),
    (["Vivaldi/"], "Vivaldi"),
    (["YaBrowser/"], "Yandex Browser"),
    (["SamsungBrowser/"], "Samsung Browser"),
    (["UCBrowser/"], "UCBrowser"),
    (["MicroMessenger/"], "MicroMessenger"),
    (["FBAN/"], "Facebook App"),
    (["FBAV/"], "Facebook App"),
    (["Instagram"], "Instagram App"),
    (["TikTok"], "TikTok App"),
    (["musical_ly"], "TikTok App"),
    (["HeadlessChrome/"], "Headless Chrome"),
    (["CriOS/"], "Chrome"),
    (["FxiOS/"], "Firefox"),
    (["Firefox/"], "Firefox"),
    (["MSIE "], "Internet Explorer"),
    (["Trident/"], "Internet Explorer"),
    (["Android", "Version/", "Chrome/"], "Android browser"),
    (["Chrome/"], "Chrome"),
    (["Chromium/"], "Chrome"),
    (["Safari/"], "Safari"),
]

# The first word in the text names the system and, unless decided by words below, the device.
SYSTEMS = [
    ("Windows Phone", "Windows Phone", PHONE),
    ("iPad", "iOS", TABLET),
    ("iPhone", "iOS", PHONE),
    ("iPod", "iOS", PHONE),
    ("Android", "Android", None),
    ("Windows NT", "Windows", DESKTOP),
    ("Windows 98", "Windows", DESKTOP),
    ("Win64", "Windows", DESKTOP),
    ("Win32", "Windows", DESKTOP),
    ("Macintosh", "macOS", DESKTOP),
    ("Mac OS X", "macOS", DESKTOP),
    ("CrOS", "ChromeOS", DESKTOP),
    ("FreeBSD", "FreeBSD", DESKTOP),
    ("BlackBerry", "BlackBerry", PHONE),
    ("BB10", "BlackBerry", PHONE),
    ("Linux", "Linux", DESKTOP),
    ("X11", "Linux", DESKTOP),
]


def _is_bot(ua: Column) -> Column:
    def rule(low: Column) -> Column:
        hit = low.endswith("bot")
        for word in BOT_WORDS:
            hit = hit | low.contains(word)
        return hit
    return let(F.lower(ua), rule)


def _labels(ua: Column) -> Column:
    own_name = F.regexp_extract(ua, r"^([A-Za-z][A-Za-z0-9._-]*)/[0-9]", 1)
    browser = let(own_name, lambda name: F.when(name.isin("", "Mozilla"), UNKNOWN_BROWSER).otherwise(name))
    for words, name in reversed(BROWSERS):
        there = ua.contains(words[0])
        for word in words[1:]:
            there = there & ua.contains(word)
        browser = F.when(there, name).otherwise(browser)
    system = F.lit(None)
    for word, name, kind in reversed(SYSTEMS):
        pair = F.struct(F.lit(name).alias("os"), F.lit(kind).alias("device"))
        system = F.when(ua.contains(word), pair).otherwise(
            system if word != SYSTEMS[-1][0] else F.struct(F.lit(UNKNOWN_OS).alias("os"), F.lit(OTHER_DEVICE).alias("device")))
    # Android says "Mobile" on phones only.
    android = F.when(F.lower(ua).contains("tablet"), TABLET).when(ua.contains("Mobile"), PHONE).otherwise(TABLET)
    return let(system, lambda s: F.struct(browser.alias("browser"), s["os"].alias("os"),
                                          F.coalesce(s["device"], android).alias("device")))


def classify_ua(ua: Column | str) -> Column:
    """Struct of browser, os and device labels. A pure row expression of substring tests: no shuffle, no lookup
    table, no regular expression on the usual path."""
    ua = F.col(ua) if isinstance(ua, str) else ua
    robot = F.struct(*[F.lit(BOT).alias(c) for c in ("browser", "os", "device")])
    return let(ua, lambda text: F.when(_is_bot(text), robot).otherwise(_labels(text)))
