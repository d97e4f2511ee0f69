"""URL filter: host rules first, then logistic regression on hashed character n-grams of host and path.

The model is fitted on a small labelled URL table: `LABELLED`, or a caller's own. Of its labels a third are block, so n-grams that
no labelled URL has lean to allow.

Contract of `judge`: one row per input row, in no order.
* urls of any length are judged whole; batches are cut by bytes.
* null url, or one without `://`: host and path are empty, no rule fits, the model judges the empty host and path.
* ties between rules can't occur: of the rules that fit, no two have equal text; the longest text wins.
* repeated rows give repeated results; an empty table gives an empty result; other columns of the input, whatever their
  names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textarrays import chunks, gram_buckets, text_bytes

#: Production rules (verdict, host, path). Fixed values.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: The default labelled URLs, labelled on principle: 1 (block) for gambling, adult, pharmacy spam, loan and money schemes, piracy,
#: link farms, trackers and malware; 0 (allow) for everything else, shops and forums included. Fixed values.
LABELLED = """
1 casino-royal.example/bonus
1 www.best-online-casino.example/free-spins
1 m.casinowin.example/slots/play
1 slots-jackpot.example/
1 poker-stars-bonus.example/register
1 free-bets-today.example/football
1 sports-betting-tips.example/odds
1 www.roulette-win.example/en/
1 bingo-lotto.example/lottery/results
1 jackpot-city.example/index.html
1 adult-video.example/watch/1001
1 xxx-tube.example/xxx/video
1 www.free-porn.example/porn/new
1 porn-gallery.example/
1 sex-cam-live.example/cams
1 hot-singles.example/meet/tonight
1 escort-service.example/girls
1 nude-pics.example/adult/12
1 webcam-sex.example/chat
1 cheap-pills.example/viagra
1 www.buy-viagra-online.example/order
1 cialis-pharmacy.example/no-prescription
1 discount-pharma.example/pills/cheap
1 weight-loss-pill.example/buy-now
1 keto-diet-miracle.example/offer
1 payday-loan.example/apply
1 quick-cash-loans.example/bad-credit
1 free-money-now.example/claim
1 make-money-fast.example/from-home
1 crypto-win.example/double-bitcoin
1 bitcoin-doubler.example/invest
1 forex-profit-robot.example/signup
1 get-rich-quick.example/secret
1 replica-watch.example/rolex
1 fake-designer-bags.example/outlet
1 torrent-crack.example/keygen/download
1 warez-download.example/crack/serial
1 movies-pirate.example/free-stream
1 keygen-serials.example/patch.exe
1 free-iphone-prize.example/winner
1 click-here-winner.example/survey
1 spam-mail.example/unsubscribe
1 link-farm.example/links/page9
1 seo-backlinks.example/buy
1 cheap-followers.example/instagram
1 banner-ads.example/click?id=4
1 ad-tracker.example/pixel.gif
1 popup-ads.example/popunder
1 malware-drop.example/payload.exe
1 phishing-login.example/verify/account
1 www.casino-bonus-club.example/vip
1 betting-bonus.example/casino
1 pills-online.example/pharmacy
1 free-bets.example/en/offers
1 www.bets-online.example/live
1 place-your-bets.example/
1 diet-pills.example/en/shop
1 cheap-meds.example/pills
1 sexy-girls.example/adult
1 lottery-winner.example/claim-prize
0 www.city-news.example/2021/05/council-vote
0 morning-herald.example/world/europe
0 library.university.example/catalog/search
0 www.national-museum.example/exhibitions
0 science-daily.example/articles/genome
0 physics.institute.example/papers/2019
0 docs.framework.example/guide/install
0 wiki.community.example/wiki/Main_Page
0 encyclopedia.example/article/River
0 forum.gardeners.example/thread/551
0 blog.baking.example/sourdough-bread
0 recipes.kitchen.example/soup/tomato
0 travel-notes.example/lisbon/itinerary
0 weather.service.example/forecast/berlin
0 www.health-advice.example/heart/diet
0 hospital.example/departments/cardiology
0 school.district.example/calendar
0 university.example/admissions
0 history.archive.example/letters/1848
0 archive.example/details/oldbooks
0 books.publisher.example/catalogue/novels
0 poetry-review.example/issues/14
0 music.conservatory.example/concerts
0 theatre.example/season/tickets
0 film-festival.example/programme
0 football-club.example/fixtures
0 running-club.example/marathon/training
0 chess.federation.example/ratings
0 www.town-council.example/minutes.html
0 government.example/forms/passport
0 court.example/judgments/2020/77
0 patents.office.example/grants
0 bank.example/accounts/savings
0 insurance.example/home/cover
0 shop.tools.example/product/hammer
0 store.outdoor.example/tents/two-person
0 furniture.example/tables/oak
0 electronics.example/laptops/13-inch
0 cars.magazine.example/reviews/estate
0 railway.example/timetable
0 airport.example/arrivals
0 maps.example/region/north
0 software.example/releases/notes
0 git.hosting.example/project/issues/3
0 developer.example/api/reference
0 status.cloud.example/incidents
0 math.example/theorems/proof
0 astronomy.example/planets/saturn
0 biology.example/cells/membrane
0 geology.example/rocks
0 language-school.example/lessons/french
0 dictionary.example/word/house
0 translation.example/en/de
0 photos.example/albums/mountains
0 painting.example/gallery/landscape
0 knitting.example/patterns/scarf
0 woodwork.example/projects/chair
0 parents.example/baby/sleep
0 pets.example/dogs/training
0 birds.example/species/robin
0 farm.example/vegetables
0 church.example/services
0 charity.example/donate
0 jobs.example/listing/engineer
0 economics.example/inflation
0 stocks.newspaper.example/markets
0 podcast.example/episodes/88
0 radio.example/schedule
0 tv-guide.example/tonight
0 comics.example/strip/400
0 puzzles.example/crossword
0 interviews.example/2018/author
0 letters.example/editor
0 en.travel.example/page/3
0 de.wetter.example/stadt/hamburg
0 fr.cuisine.example/recette/tarte
0 es.noticias.example/economia
0 www.brunthal.example/
0 zalvora.example/index.html
0 m.kestrin.example/about
0 ondarrow.example/fr/221
0 blog.mirelle.example/2017/11
0 halvorsen.example/contact?lang=en
0 static.quillon.example/1234.html
0 www.ardenne.example/es/77
0 thornbury.example/history
0 northern-mills.example/en/452
0 another-station.example/page?id=7
0 motion-studies.example/de/12.html
"""

_SIZES, _BUCKETS = (2, 3, 4, 5), 1 << 15
_CHUNK, _MOST = 1 << 20, 10_000
_TO_LOWER = {c: c + 32 for c in range(65, 91)}


def labelled_urls(lines: str = LABELLED) -> pd.DataFrame:
    """A training table (host, path, label; label 1 is block) from lines of a label and a URL without scheme."""
    rows = [("", "", 0)]
    for label, url in (line.split() for line in lines.split("\n") if line.strip()):
        host, slash, path = url.partition("/")
        rows.append((host.translate(_TO_LOWER), re.split("[?#]", slash + path)[0], int(label)))
    return pd.DataFrame(rows, columns=["host", "path", "label"])


def _features(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Row number and bucket of each n-gram; host and path hash into halves of their own."""
    rows, buckets = [], []
    for half, column in enumerate((host, path)):
        framed = pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise("^", column, "$", ""))
        data, offsets = text_bytes(framed)
        for n in _SIZES:
            r, b = gram_buckets(data, offsets, n, _BUCKETS // 2)
            rows.append(r)
            buckets.append(b + half * (_BUCKETS // 2))
    return np.concatenate(rows), np.concatenate(buckets), len(host)


def train(labelled: pd.DataFrame, rounds: int = 300, ridge: float = 1e-3) -> np.ndarray:
    """Weights and bias by full-batch gradient steps on a small labelled table (host, path, label of at most 10,000 rows)."""
    if len(labelled) > _MOST:
        raise ValueError(f"the labelled table is trained on the driver and holds at most {_MOST} rows")
    rows, buckets, n = _features(pa.array(labelled["host"], pa.string()), pa.array(labelled["path"], pa.string()))
    used, column = np.unique(buckets, return_inverse=True)
    x = np.zeros((n, len(used) + 1))
    np.add.at(x, (rows, column), 1.0)
    x[:, :-1] /= np.maximum(1, np.linalg.norm(x[:, :-1], axis=1, keepdims=True))
    x[:, -1] = 1
    y, w, m, v = labelled["label"].to_numpy(float), np.zeros(len(used) + 1), 0.0, 0.0
    for t in range(1, rounds + 1):
        g = x.T @ (1 / (1 + np.exp(-x @ w)) - y) / n + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(_BUCKETS + 1)
    weights[used], weights[-1] = w[:-1], w[-1]
    return weights


def probability(weights: np.ndarray, host: pa.Array, path: pa.Array) -> np.ndarray:
    rows, buckets, n = _features(host, path)
    flat, counts = np.unique(rows * _BUCKETS + buckets, return_counts=True)
    row, bucket = flat // _BUCKETS, flat % _BUCKETS
    norm = np.sqrt(np.bincount(row, counts.astype(float) ** 2, n))
    total = np.bincount(row, weights[bucket] * counts, n) / np.maximum(1, norm)
    return 1 / (1 + np.exp(-(total + weights[-1])))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no `://`."""
    found = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(found > 0, F.substring(url, found + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest) + 1), r"^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labelled: pd.DataFrame | DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, p_block (the model's), verdict; the rule's verdict goes before the model's. `labelled`: host, path, label (1: block)."""
    if isinstance(labelled, DataFrame):
        labelled = labelled.select("host", "path", "label").limit(_MOST + 1).toPandas().sort_values(["host", "path", "label"])
    weights = pages.sparkSession.sparkContext.broadcast(train(labelled_urls() if labelled is None else labelled))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "path", _CHUNK):
            p = probability(weights.value, b.column("host"), b.column("path"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, "p_block"])

    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    kind = parts.schema["page_id"].dataType.simpleString()
    scored = parts.mapInArrow(score, f"page_id {kind}, host string, path string, p_block double")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), "p_block", F.coalesce(verdict, by_model).alias("verdict"))
