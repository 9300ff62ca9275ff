"""URL filters: host rules first; a word-level model judges the rest.

Rules are (host, path) prefixes: a rule fits its host and all subdomains if the url's path starts with the rule's, and the
longest wins. Other urls are judged by multinomial naive Bayes over tokens: the letter runs (labels) of host and path, split into
words by a unigram Viterbi pass.

The splitter's lexicon has two parts: the words of a public vocabulary, by rank (Zipf), of fixed size and shipped with the tasks; and the words of all
pages' texts with their counts. The second grows with the corpus and is never shipped: the distinct labels' substrings are joined
to it, so each label brings just the words that it may hold. Every distinct label is split once, however many urls share it.

The classifier is fitted on host names labelled by hand (``KNOWN``), split by the same lexicon: a bounded set, whatever the corpus. A url's
verdict is the sum of its tokens' weights and the prior; tokens that no labelled name has weigh nothing. No single word decides.

Null urls and urls without ``://`` have an empty host and path, fit no rule and are allowed; so are hosts without a letter. Repeated rows are
judged each. Letter runs of over ``LONGEST_LABEL`` letters (longer than any host label) are split in stretches of that length.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, ship, staged, tagged

#: (verdict, host/path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
# Host names labelled by hand, the training set of the classifier.
KNOWN = {
    "bad": """royal-casino-bonus.com lucky-slots.net onlinepokerroom.com bestbets24.com football-bets-tips.net sportsbetting-odds.com jackpotwins.net roulette-casino.biz freespins-bonus.com winbigjackpot.com
        cheapviagra-online.com discount-pills.net buy-cialis-cheap.com steroids-shop.biz cheap-pharmacy-pills.com noprescription-meds.net dietpills-miracle.com replica-watches-outlet.net fakepassports.biz
        free-porn-videos.com xxx-tube.net adultcams-live.com sexchat-girls.com hotescorts.net nude-webcam.com adult-dating-sex.com hardcore-xxx.biz
        payday-loans-fast.com quickcash-loans.net getrichquick-money.com free-crypto-giveaway.net bitcoin-doubler.biz instant-cash-win.com
        spam-mailer.net linkfarm-seo.com buy-backlinks-cheap.net spamlinks.biz keyword-spam-farm.net clickbait-farm.com
        ad-tracker.net ads-server.com adclick-track.com popunder-ads.net tracking-pixel-ads.com doubleclick-ads.net adware-toolbar.biz banner-ads-network.com
        adult-blog.net casino-blog.com spam-blog.net
        free-warez-crack.net keygen-download.biz torrent-crack.com malware-update.net phishing-login.biz free-movie-downloads-crack.net""".split(),
    "good": """dailynews.com city-library.org gardenclub.org weather-report.net localhistory.org university-press.edu hospital-care.org schoolbooks.com travel-guide.net cooking-recipes.com
        musicfestival.org museum-of-art.org science-weekly.com health-advice.org family-farm.com bookstore-online.com mountain-bikes.net river-walk.org open-source-software.org
        blog-about-cats.com photography-tips.net home-repair-guide.com language-school.com national-park.org football-club.com chess-players.net car-reviews.com
        bank-of-the-west.com insurance-advice.com real-estate-homes.com small-business-blog.net free-online-courses.org job-center.org city-council.gov
        parents-magazine.com baby-names.net dog-training.com veterinary-clinic.com organic-food-market.com coffee-house.com restaurant-guide.net
        kitchen-design.com fashion-week.com knitting-patterns.net children-stories.org theatre-tickets.com film-review.net radio-station.org podcasts-daily.com
        math-tutor.com physics-forum.org history-of-science.org chemistry-lab.edu space-exploration.org engineering-journal.com data-analysis-blog.com computer-repair.net""".split(),
}
# Words of such names that common vocabularies leave out.
EXTRA = "porn porno viagra cialis keygen warez hentai phishing adware malware spam spammer backlinks popunder doubleclick clickbait payday jackpot escorts".split()
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
PRIOR, SMOOTH = 0.2, 0.2
LONGEST_LABEL, LONGEST_WORD = 64, 20
#: Weight of the corpus against the vocabulary in a word's probability.
CORPUS_SHARE = 0.5
#: Weights are whole multiples of this, so that sums are exact in any order.
UNIT = 1e-6


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict), null where no rule fits."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def labels_of(part: Column) -> Column:
    """The letter runs of a host or path, lower case."""
    return F.regexp_extract_all(F.lower(part), F.lit(rf"\p{{L}}{{1,{LONGEST_LABEL}}}"), F.lit(0))


def vocabulary(path: str = VOCABULARY) -> tuple[str, ...]:
    """Whole words of a public vocabulary, most frequent first; read on the driver."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)["model"]["vocab"]
    whole = [w[:-4] for w in sorted(found, key=found.get) if w.endswith("</w>") and w[:-4].isalpha() and len(w) - 4 <= LONGEST_WORD]
    return tuple(dict.fromkeys([*whole, *EXTRA]))


def zipf(words: Iterable[str]) -> dict[str, float]:
    """Probabilities in proportion to 1 / rank."""
    ranked = {w: 1.0 / (k + 1) for k, w in enumerate(words)}
    total = sum(ranked.values())
    return {w: p / total for w, p in ranked.items()}


def split(label: str, base: Mapping[str, float], counts: Mapping[str, int], total: int, longest: int = LONGEST_WORD) -> list[str]:
    """The most probable words of a label; of equals the split whose last words begin first. An unknown stretch costs by its length."""
    share = CORPUS_SHARE if total else 0.0
    best, start = [0.0], [0]
    for end in range(1, len(label) + 1):
        found = (float("-inf"), 0)
        for begin in range(max(0, end - longest), end):
            word = label[begin:end]
            p = (1.0 - share) * base.get(word, 0.0) + (share * counts.get(word, 0) / total if total else 0.0)
            found = max(found, (best[begin] + (math.log(p) if p else -20.0 - 3.0 * (end - begin)), -begin))
        best.append(found[0])
        start.append(-found[1])
    parts, end = [], len(label)
    while end:
        parts.append(label[start[end] : end])
        end = start[end]
    return parts[::-1]


def lexicon(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n): the words of all pages' texts."""
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "(?s)<script.*?</script>|<style.*?</style>|<[^>]*>|&\\w+;", " "))
    return pages.select(F.explode(F.regexp_extract_all(plain, F.lit(r"\p{L}+"), F.lit(0))).alias("word")).filter(F.length("word") <= LONGEST_WORD).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def segments(labels: DataFrame, words: DataFrame, base: Iterable[str]) -> DataFrame:
    """(label, words) of every distinct ``label``: its substrings meet the lexicon ``words``, and what it may hold comes back to it."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    distinct = labels.select("label").distinct()
    size = F.length("label")
    inner = F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), size - i + 1)), lambda k: F.col("label").substr(i, k)))
    met = distinct.select("label", F.explode(F.array_distinct(F.flatten(inner))).alias("word")).join(words, "word")
    held = met.groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("held"))
    listed = "\n".join(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zipf(listed.split("\n")) if listed else {}
        for batch in batches:
            found = [split(label, known, {h["word"]: h["n"] for h in own or ()}, total) for label, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["label", "words"])

    return distinct.join(held, "label", "left").select("label", "held").mapInArrow(run, "label string, words array<string>")


def tokens(host_labels: Iterable[str], path_labels: Iterable[str], words: Mapping[str, Iterable[str]]) -> Counter[str]:
    return Counter([f"h:{w}" for label in host_labels for w in words[label]] + [f"p:{w}" for label in path_labels for w in words[label]])


def fit_classes(good: Iterable[Counter[str]], bad: Iterable[Counter[str]], prior: float = PRIOR, smooth: float = SMOOTH) -> dict[str, int]:
    """Naive Bayes weights (in ``UNIT``) of tokens for bad against good; the entry "" is the prior's."""
    counts = [sum(examples, Counter()) for examples in (good, bad)]
    every = sorted({*counts[0], *counts[1]})
    total = [sum(c.values()) + smooth * len(every) for c in counts]
    weight = lambda t: math.log((counts[1][t] + smooth) / total[1]) - math.log((counts[0][t] + smooth) / total[0])
    return {t: round(weight(t) / UNIT) for t in every} | {"": round(math.log(prior / (1.0 - prior)) / UNIT)}


def located(pages: DataFrame, url_col: str = "url", rules: Iterable[tuple[str, str]] = RULES, *keep: Column) -> DataFrame:
    host, path = host_of(F.col(f"`{url_col}`")), path_of(F.col(f"`{url_col}`"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), tuple(rules))
    found = pages.select(*keep, host.alias("host"), path.alias("path"))
    return found.select("*", rule.alias("rule"), verdict.alias("ruled"), labels_of(F.col("host")).alias("host_labels"), labels_of(F.col("path")).alias("path_labels"))


def judge(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: tuple[str, ...] = ("page_id",), rules: Iterable[tuple[str, str]] = RULES, known: Mapping[str, Iterable[str]] = KNOWN, base: Iterable[str] | None = None) -> DataFrame:
    """``keep`` columns with ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (log odds of bad; null where a rule decides)."""
    spark = ship(pages.sparkSession)
    base = tuple(vocabulary() if base is None else base)
    every, tag = tagged(pages, "pages")
    found = staged(located(every, url_col, rules, F.col(tag).alias("tag"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")), "urls")
    examples = spark.createDataFrame([(what, f"x://{name}") for what, names in known.items() for name in names], "what string, url string")
    taught = located(examples, "url", (), F.col("what"))
    labels = lambda df: df.select(F.explode(F.array_union("host_labels", "path_labels")).alias("label"))
    words = staged(lexicon(pages, html_col), "lexicon")
    split_ = staged(segments(labels(found.filter("ruled is null")).unionByName(labels(taught)), words, base), "segments")

    by_label = {r.label: r.words for r in split_.join(F.broadcast(labels(taught).distinct()), "label", "left_semi").collect()}
    seen = taught.collect()
    weights = fit_classes(*[[tokens(r.host_labels, r.path_labels, by_label) for r in seen if r.what == what] for what in ("good", "bad")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).to_pylist()
            scores = [pa.array([sum(weights.get(f"{side}:{w}", 0) for w in ws) for ws in lists], pa.int64()) for side in "hp"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *scores], ["label", "h", "p"])

    scored = split_.mapInArrow(run, "label string, h long, p long").filter("h != 0 or p != 0")
    open_ = found.filter("ruled is null")
    side = lambda of: F.transform(f"{of}_labels", lambda x: F.struct(x.alias("label"), F.lit(of).alias("side")))
    each = open_.select("tag", F.explode(F.concat(side("host"), side("path"))).alias("l")).select("tag", "l.label", "l.side")
    sums = each.join(scored, "label").groupBy("tag").agg(F.sum(F.when(F.col("side") == "host", F.col("h")).otherwise(F.col("p"))).alias("sum"))
    score = F.when(F.col("ruled").isNull(), F.coalesce("sum", F.lit(0)) + F.lit(weights[""]))
    verdict = F.coalesce("ruled", F.when((F.size("host_labels") > 0) & (score > 0), "block").otherwise("allow"))
    return found.join(sums, "tag", "left").select("kept.*", "host", "path", "rule", verdict.alias("verdict"), (score * UNIT).alias("score"))
