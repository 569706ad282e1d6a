"""URL filters: listed rules first, then logistic regression on hashed character n-grams of host and path.

Everything on the documents' side is DataFrame expressions.  The regression is fitted once, on the driver,
from the small labelled table below; its weights are one literal array of BUCKETS numbers.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`,
`#` or the end.  A rule fits its host and all subdomains, where the path starts with the rule's path; the
longest fitting rule decides.

Defined results: a null URL, or one without `://`, has an empty host and path, no rule, and the verdict of
the regression for empty text; repeated rows each get a verdict.
"""

from __future__ import annotations

import math
from functools import cache
from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: The labelled table: hosts and paths of unwanted kinds (gambling, pills, adult, loans, fraud, pirated software,
#: advertising) and of wanted ones, written for it; no row is taken from any corpus.
BLOCKED = """
free-bets.com/en/1 casino-bonus.org/play best-casino.com/slots online-poker.com/win sports-bets.org/odds live-casino.net/roulette
royalslots.com/spin pokerbonus.org/join bet-football.com/odds betting-tips.org/today lucky-jackpot.com/spins bingo-bonus.com/play
cheap-pills.com/buy buy-pills-online.org/shop viagra-shop.com/order cheap-meds.com/12 diet-pills.org/offer cialis-online.com/buy-now
pharma-discount.net/pills weight-loss-miracle.com/order hot-xxx.com/video adult-cams.org/live free-porn.com/watch sexy-dates.org/chat
xxx-tube.net/videos hotcams.com/girls adult-dating.com/singles nude-pics.org/gallery sex-chat.com/live adult-films-free.org/hd
win-prizes.com/claim free-money.org/now lottery-winner.com/claim claim-reward.net/gift free-iphone.com/winner gift-card-free.org/claim
fast-loans.com/apply payday-loans.org/cash quick-cash.com/loan bad-credit-loans.net/apply instant-loan.org/approved debt-relief.com/cash-now
crypto-doubler.com/invest bitcoin-profit.org/invest forex-signals.net/profit get-rich-quick.com/invest make-money-fast.org/join
replica-watches.org/sale cheap-handbags.com/replica discount-replica.net/rolex warez-download.com/crack keygen-crack.org/serial
download-torrent.com/free free-cracks.net/keygen torrent-movies.org/download cracked-apps.com/apk serial-keys.org/crack
click-ads.org/track popunder-ads.com/serve tracker-pixel.org/ads adserver.net/banner ads.clicktrack.com/pixel popup-ads.org/click
banner-exchange.com/click affiliate-clicks.net/track pixel.adnetwork.com/serve verify-account-login.com/bank secure-wallet-login.net/verify
account-update.org/password bank-verify.com/signin free-casino.com/7 casinoslots.org/bonus pokerstars-bonus.net/free bets-online.com/win
cheap-viagra.org/pills online-pharmacy-pills.com/cheap loans-cash.org/payday porn-videos.net/xxx camgirls.com/live-sex
""".split()
ALLOWED = """
www.university.org/research news.daily.com/world blog.author.org/2020/notes docs.library.com/guide www.museum.org/history
wiki.science.com/physics m.weather.org/today www.recipes.com/bread forum.garden.org/topics www.cityhall.com/services school.org/lessons
blog.travel.com/14 shop.books.org/novels www.journal.com/31 health.clinic.org/advice www.music.com/reviews code.project.org/readme
www.nature.com/birds www.college.org/admissions library.city.org/catalogue www.gazette.com/politics morningpost.net/2021/06/economy
www.theatre.org/season www.gallery.com/exhibitions www.bakery.com/about www.orchestra.org/concerts botanical-garden.org/plants
www.observatory.org/stars farm-market.com/vegetables www.hospital.org/departments chess-club.net/tournaments www.railway.org/timetable
hiking-trails.com/maps www.parish.org/events www.carpentry.com/workshop cooking.family.net/soups www.astronomy.org/planets
docs.software.org/install www.linguistics.org/papers www.parliament.org/debates history.archive.org/documents www.physics.org/lectures
www.kindergarten.com/parents photo.studio.com/portraits www.architecture.org/buildings geology.institute.org/maps www.radio.com/programme
www.choir.org/rehearsals village-news.com/council www.bicycle.org/repair local.history.net/stories www.statistics.org/tables
encyclopedia.com/article/volcano dictionary.org/word/house www.translation.org/services www.engineering.com/bridges
pets.veterinary.org/advice www.hotel.com/rooms restaurant.com/menu www.cinema.org/films www.yoga.org/classes swim-club.org/results
en.reference.org/wiki/Rome de.reference.org/wiki/Berlin fr.reference.org/wiki/Paris www.biology.org/cells www.mathematics.org/proofs
blog.gardening.com/roses www.poetry.org/poems m.news.com/sports/football www.marathon.org/results www.beekeeping.com/honey
www.public-library.org/opening-hours www.community.org/volunteers www.philosophy.org/essays www.economist-notes.com/markets
climate.research.org/data ocean.institute.org/tides www.novelist.com/chapters www.teacher.org/worksheets open-data.org/datasets
tutorial.programming.org/loops www.fishing.org/rivers www.knitting.com/patterns www.heritage.org/castles www.fire-brigade.org/safety
""".split()

BUCKETS, GRAMS = 4096, (3, 4)
#: A URL whose blocking probability reaches this is blocked.
LIMIT = 0.8
EPOCHS, RATE, DECAY = 60, 0.02, 1e-5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _grams(text: str) -> list[int]:
    found = []
    for n in GRAMS:
        for i in range(len(text) - n + 1):
            h = n
            for c in text[i : i + n]:
                h = h * 131 + ord(c)
            found.append(h % BUCKETS)
    return found


def train(rows: list[tuple[str, int]]) -> tuple[list[float], float]:
    """Weights and bias from (host and path, 1 if unwanted), by gradient descent with an L2 penalty, in the order of rows."""
    known = [(_grams(f"^{u}$"), y) for u, y in rows]
    w, b = [0.0] * BUCKETS, 0.0
    for _ in range(EPOCHS):
        for grams, y in known:
            p = 1 / (1 + math.exp(-(b + sum(w[g] for g in grams))))
            for g in grams:
                w[g] -= RATE * (p - y) + DECAY * w[g]
            b -= RATE * (p - y)
    return w, b


def labelled() -> list[tuple[str, int]]:
    """The labelled table, kinds in turn as far as both go."""
    pairs = zip_longest(((u, 1) for u in BLOCKED), ((u, 0) for u in ALLOWED))
    return [row for pair in pairs for row in pair if row is not None]


@cache
def weights() -> tuple[tuple[float, ...], float]:
    w, b = train(labelled())
    return tuple(round(x, 6) for x in w), round(b, 6)


def _logit_limit() -> float:
    return round(math.log(LIMIT / (1 - LIMIT)), 6)


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _by_length(rules) -> list:
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """A struct of the deciding rule and its verdict; null where none fits."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in reversed(_by_length(rules)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def logit(host: Column, path: Column) -> Column:
    """The regression's logit.  The text is split into code points once for each row, so work is in proportion to it."""
    w, b = weights()
    table = F.split(F.lit(",".join(map(str, w))), ",").cast("array<double>")

    def of_length(codes: Column, n: int) -> Column:
        def weight(i: Column) -> Column:
            h = F.lit(n).cast("long")
            for k in range(n):
                h = h * 131 + F.get(codes, i + k)
            return F.element_at(table, (h % BUCKETS).cast("int") + 1)

        count = F.size(codes) - n + 1
        places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, F.lit(0.0), lambda acc, i: acc + weight(i))

    def total(codes: Column) -> Column:
        out = F.lit(b)
        for n in GRAMS:
            out = out + of_length(codes, n)
        return out

    codes = F.transform(F.split(F.concat(F.lit("^"), host, path, F.lit("$")), ""), F.ascii)
    return F.element_at(F.transform(F.array(codes), total), 1)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, score (blocking probability), verdict."""
    host, path = host_path(F.col("url").cast("string"))
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    split = split.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).withColumn("logit", logit(F.col("host"), F.col("path")))
    by_method = F.when(F.col("logit") >= _logit_limit(), "block").otherwise("allow")
    score = 1 / (1 + F.exp(-F.col("logit")))
    return split.select("page_id", "host", "path", F.col("found.rule").alias("rule"), score.alias("score"), F.coalesce(F.col("found.verdict"), by_method).alias("verdict"))


def sql(rules=RULES) -> str:
    """DuckDB: the rows of judge(), without score."""
    w, b = weights()
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{what(v, h, p)}'" for v, h, p in _by_length(rules)) + " END"
    sums = []
    for n in GRAMS:
        h = f"CAST({n} AS BIGINT)"
        for k in range(n):
            h = f"({h} * 131 + unicode(substr(t, CAST(i + {k} AS BIGINT), 1)))"
        sums.append(f"coalesce(list_sum(list_transform(range(1, greatest(1, length(t) - {n} + 2)), lambda i: w[{h} % {BUCKETS} + 1])), 0)")
    return f"""
WITH weights AS (SELECT CAST([{",".join(map(str, w))}] AS DOUBLE[]) AS w),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rest),
parts AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
texts AS (SELECT *, '^' || host || path || '$' AS t FROM parts),
scored AS (SELECT page_id, host, path, {b} + {" + ".join(sums)} AS logit FROM texts, weights)
SELECT page_id, host, path, {case(lambda v, h, p: h + p)} AS rule,
       coalesce({case(lambda v, h, p: v)}, CASE WHEN logit >= {_logit_limit()} THEN 'block' ELSE 'allow' END) AS verdict
FROM scored
"""
