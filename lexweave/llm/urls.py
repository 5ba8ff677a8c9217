"""URL filter: rules on host and path first, then a logistic regression on hashed character n-grams
of host and path, trained here from a small labelled URL table.

Defined results: a null url, and one without "://", has an empty host and path, no rule, and is
allowed, as nothing speaks against it. Of rules of the same length the first counts; very long urls are judged whole. Repeated rows are judged
alike; only key and url are read. An empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lexweave.llm.common import rowwise

#: (verdict, host, path) of the rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
WIDTH = 1 << 14
GRAMS = (3, 4, 5)

#: The labelled table: hosts and paths of unwanted and of wanted kinds, made by hand from what such sites are called. Fixed values.
UNWANTED = """www.casino-bonus.net/win best-casino.com/slots online-casino.info/poker casinoroyal.org/play win-big-casino.biz/jackpot lucky-casino.net/en/spins mega-casino-win.com/fr/bonus
bet365-tips.com/odds freebets.co/sport sports-betting.net/free betting-odds.org/tips super-bets.info/bonus free-bet-now.com/de/tip bets-for-free.net/en/4
cheap-meds.com/pills pills-online.net/viagra discount-pharmacy.biz/pills buy-cheap-pills.org/order weightloss-pills.info/offer cheap-pill-shop.com/fr/2 pills4cheap.net/es/9
adult-chat.com/cams xxx-adult.net/video adult-dating.org/sex hot-adult-x.biz/free porn-tube.info/xxx adultvideo.net/en/31 x-adult.org/de/clips
ads-server.com/track track-ads.net/click adclick-track.org/banner popup-ads.biz/track clicktrack.info/ads adtrack.net/en/pixel ads.tracker.com/fr/banner
spam-links.com/farm link-farm.net/seo spam-blog.org/post linkfarm-spam.biz/links content-farm.info/spam spamfarm.net/en/seo farm-of-spam.com/de/links
payday-loans.com/fast quick-loan.net/apply crypto-giveaway.org/win lottery-win.biz/prize replica-watches.info/cheap warez-crack.net/download torrent-crack.org/keygen
m.casino-club.net/en/33 www.casino-winner.org/de/812.html blog.grand-casino.com/es/5/ casino.winbig.net/fr/4410 m.bets-online.org/en/77 www.free-odds-bets.com/es/301 free-betting.net/de/19
m.pills-direct.com/en/640 www.cheap-viagra-pills.net/fr/88.html blog.diet-pills.org/es/2 m.adult-zone.com/en/120 www.adult-live.net/de/9/ blog.adult-movies.org/en/5512 adult-toons.com/fr/17
m.ads-network.net/en/505 www.ads-click.com/de/1200 ads-banner.org/es/41.html blog.click-track.net/en/9 ad-tracking.com/fr/73/ m.spam-site.org/en/28 www.spam-mailer.com/de/3060
blog.spam-zone.net/es/6.html spam-seo.com/fr/990 m.link-farm-pro.com/en/14 farm-clicks.net/de/7 www.payday-cash.net/en/2 m.lottery-winners.com/es/37 replica-bags.org/fr/81.html""".split()
WANTED = """news.city-herald.com/world/article university.edu/research/paper library.org/catalog/books museum.net/exhibits/painting
weather-service.gov/forecast/today docs.python.org/library/index wiki.encyclopedia.org/history/rome recipes-kitchen.com/soup/onion
travel-guide.net/italy/rome gardening.org/roses/care school-district.edu/calendar science-journal.com/biology/cells
health-clinic.org/doctors hospital.net/visitors music-review.com/albums/jazz film-archive.org/silent photo-club.net/gallery
railway-timetable.com/stations city-council.gov/minutes open-data.org/datasets maps.region.net/north chess-club.org/results
bookshop.com/novels/classics astronomy.edu/stars/catalog engineering.net/bridges history-society.org/letters poetry.net/sonnets
x.com/home t.co/news a.org/en b.net/about ab.de/wissen x.net/fr/1 m.site.org/en/12 www.site.com/de/388 blog.site.net/es/7040.html en.wikipedia.org/wiki/Bridge
bbc.co.uk/news/world-123 lemonde.fr/politique/article elpais.com/es/cultura spiegel.de/de/wirtschaft arxiv.org/abs/1706 github.com/apache/spark
stackoverflow.com/questions/11227809 nature.com/articles/en/41586 who.int/fr/news europa.eu/de/index.html canada.ca/fr/services gov.uk/guidance
blog.orchestra.org/en/2041 www.thornton.net/en/5 m.heather.com/es/31 shore.anderson.org/fr/10 reading.hanover.net/de/77.html ministry.gov/es/90 www.hampton.com/en/6021/ brenthon.org/fr/14
the-weekly-reader.com/en/33 estate-agents.net/es/208 interest.org/de/41 reston.net/en/981/ andover.edu/fr/library thistle.org/en/3390.html ontario.ca/fr/6 attire.com/de/551
www.orchard.net/en/266 m.lighthouse.net/en/77 blog.mountain.com/en/5018 www.harbour.net/en/2518/ blog.winter-garden.net/fr/31 m.townhall.org/de/604.html www.village-news.com/en/8 blog.teachers.net/es/19/
m.theatre.com/fr/2250 www.meadow.org/es/73.html blog.rivers.net/de/9001 m.stations.net/en/410/ www.bakery.com/fr/55 blog.kitchen.org/en/1830.html m.forest.com/en/3 www.children.net/de/162
blog.hiking.com/en/7714/ m.cycling.net/es/28.html www.painting.org/en/640 blog.museum-friends.net/en/91 m.weather.org/fr/4407 www.thermal-baths.com/de/85/ blog.tourism.net/en/206.html m.history.net/en/5250
www.national-trust.net/en/88.html blog.nations.com/de/37 m.thought.org/en/912 www.other-shore.net/es/6600 blog.stone-houses.org/en/14/ m.winery.net/fr/120.html www.winding-roads.com/en/3300 m.adults-learning.org/en/7""".split()


def labelled() -> pd.DataFrame:
    """The small labelled table: url, blocked."""
    return pd.DataFrame([(f"http://{u}", y) for y, us in ((1, UNWANTED), (0, WANTED)) for u in us], columns=["url", "blocked"])


def parts(url: str | None) -> tuple[str, str]:
    """Host with A-Z in lower case, and path."""
    if url is None:
        return "", ""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:end]


def slots(kind: int, s: str) -> np.ndarray:
    """Places of the n-grams of one part; a part in `^` and `$`."""
    b = np.frombuffer(f"^{s}$".encode("utf-8", "replace"), np.uint8).astype(np.uint64)
    out = []
    for n in GRAMS:
        if len(b) >= n:
            h = np.full(len(b) - n + 1, np.uint64(n * 2 + kind))
            for i in range(n):
                h = h * np.uint64(0x100000001B3) + b[i : len(b) - n + 1 + i]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            out.append((h >> np.uint64(64 - 14)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def vector(url: str | None) -> np.ndarray:
    host, path = parts(url)
    return np.concatenate([slots(0, host), slots(1, path)])


def train(table: pd.DataFrame, steps: int = 300, rate: float = 0.3, decay: float = 1e-3) -> np.ndarray:
    """Weights, the last of which is the bias. Each url's n-grams weigh one together (their root), so that long ones don't prevail."""
    x = np.zeros((len(table), WIDTH + 1))
    for i, u in enumerate(table["url"]):
        v = vector(u)
        np.add.at(x[i], v, 1 / np.sqrt(max(1, len(v))))
        x[i, WIDTH] = 1
    y = table["blocked"].to_numpy(float)
    w, square = np.zeros(WIDTH + 1), np.full(WIDTH + 1, 1e-8)
    for _ in range(steps):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y) / len(y) + decay * w
        square += g * g
        w -= rate * g / np.sqrt(square)
    return w


def score(weights: np.ndarray, url: str | None) -> float:
    """Likelihood that the url is unwanted."""
    v = vector(url)
    return float(1 / (1 + np.exp(-np.clip(weights[v].sum() / np.sqrt(max(1, len(v))) + weights[WIDTH], -30, 30))))


def rule_for(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """(verdict, rule) of the longest rule that fits."""
    best = None
    for verdict, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = verdict, h + p
    return best


def judge(pages: DataFrame, table: pd.DataFrame | None = None, key: str = "page_id", url: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """key, host, path, rule, score, verdict of each row. Only key and url are read; there is no shuffle."""
    weights = train(labelled() if table is None else table)

    def start():
        at_host = lru_cache(50_000)(lambda h: (weights[v := slots(0, h)].sum(), len(v)))

        def run(found: list) -> list:
            rows = []
            for u in found:
                host, path = parts(u)
                rule = rule_for(host, path, rules)
                total, n = at_host(host)
                v = slots(1, path)
                p = float(1 / (1 + np.exp(-np.clip((total + weights[v].sum()) / np.sqrt(max(1, n + len(v))) + weights[WIDTH], -30, 30))))
                blocked = bool(host or path) and p >= threshold
                rows.append((host, path, rule[1] if rule else None, p, rule[0] if rule else "block" if blocked else "allow"))
            return list(zip(*rows)) or [()] * 5

        return run

    return rowwise(pages, key, url, "host string, path string, rule string, score double, verdict string", start)
