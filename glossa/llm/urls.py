"""URL filters: rules first, then a logistic regression on hashed character n-grams of host and path.

The model is fitted by Spark ML on the labelled URLs of this module; every run fits the same one. Features are the 2- to
4-grams of ``host`` and of ``path``, with their ends marked, hashed into FEATURES slots. Wanted URLs are the greater part of
the table, so that names of which the model knows nothing are let through.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case. Path: from there up to ``?``, ``#``
or the end. Without ``://``, or for null, both are empty. A rule fits its host and all subdomains if the path starts with the
rule's; the longest rule that fits wins, and the model judges what no rule fits.

Defined cases: see above; rows that repeat give equal results; an empty table gives no rows; very long urls are judged whole;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES, THRESHOLD = 1 << 14, 0.5
SIZES = (2, 3, 4)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

# Labelled URLs, without their scheme.
UNWANTED = """
    best-casino-bonus.com/slots/free-spins www.online-casino24.net/roulette casinoroyalplay.com/bonus poker-stars-free.net/texas-holdem lucky-slots-777.com/jackpot/win megajackpotslots.org/play betting-tips-today.com/football/odds www.sportsbetpro.net/live-bets bet-now-win-big.com/register vegas-gambling-club.com/blackjack
    www.freespinsdaily.net/no-deposit crypto-casino-slots.io/promo bingo-bonus-cash.com/join www.livebetodds.com/horse-racing gamblinghub.net/best-poker-rooms buy-cheap-viagra.com/order cheap-pills-online.net/no-prescription www.discount-pharmacy24.com/cialis pharmacy-no-rx.com/buy/xanax canadian-pills-store.com/shop/viagra
    generic-meds-express.net/levitra buyonlinepills.org/weight-loss dietpillsmiracle.com/fat-burner www.enlarge-pills-now.com/order rx-meds-cheap.com/tramadol sexy-live-cams.com/girls adultdating-hookup.net/join www.xxx-videos-free.com/porn/hd hotpornclips.net/watch freepornmovies.org/category/amateur
    escort-girls-city.com/models nude-webcam-chat.com/live www.hookupsnearyou.net/adult adultxxxcams.com/free milf-dating-site.net/signup payday-loans-fast.com/apply www.instant-cash-loans.net/bad-credit nocreditcheckloans.org/payday quick-payday-advance.com/apply-now debt-relief-instant.com/loan
    forex-robot-profit.com/signals binary-options-rich.net/trade bitcoin-doubler-fast.com/invest www.crypto-profit-bot.io/earn get-rich-quick-system.com/money make-money-online-now.net/work-at-home earn-1000-daily.com/secret www.mlm-success-cash.com/join free-bitcoin-generator.net/claim hyip-profit-invest.com/plan
    replica-watches-shop.com/rolex www.fake-handbags-outlet.net/gucci cheap-replica-bags.com/louis-vuitton discount-rayban-outlet.com/sale luxury-replica-store.net/omega free-crack-download.com/keygen www.serial-keygen-crack.net/windows warez-full-download.org/cracked torrent-movies-free.net/download/1080p full-version-crack.com/activator
    nulled-scripts-free.net/themes apk-mod-hack.com/unlimited-coins game-cheats-hack.net/generator free-gift-card-codes.com/generator www.robux-generator-free.com/claim ad-server-track.com/click ads.clicktracker.net/banner/468 popup-ads-network.com/serve track.adclick-media.com/redirect adnetwork-banner.net/impression
    www.click-bait-news.com/you-wont-believe shocking-celebrity-secrets.net/gossip doctors-hate-this-trick.com/weight-loss one-weird-trick.net/belly-fat viral-clickbait-stories.com/top-10 win-free-iphone.com/survey you-are-a-winner.net/prize/claim claim-your-prize-now.com/lottery www.free-survey-rewards.net/gift lottery-winner-alert.com/claim
    secure-login-verify-account.com/paypal/signin update-your-bank-account.net/verify www.account-suspended-alert.com/login apple-id-unlock-verify.net/signin virus-alert-support.com/call-now fix-your-pc-now.net/malware/download free-antivirus-scan-alert.com/warning www.buy-followers-likes.com/instagram seo-backlinks-cheap.net/buy spam-email-lists.com/download
""".split()
WANTED = """
    en.wikipedia.org/wiki/Photosynthesis de.wikipedia.org/wiki/Eisenbahn fr.wikipedia.org/wiki/Paris es.wikipedia.org/wiki/Literatura www.britannica.com/science/geology www.gutenberg.org/ebooks/1342 archive.org/details/texts www.nature.com/articles/d41586 www.science.org/journal/science arxiv.org/abs/1706.03762
    pubmed.ncbi.nlm.nih.gov/12345678 www.nih.gov/health-information www.nasa.gov/missions www.noaa.gov/weather www.who.int/news www.un.org/en/about-us europa.eu/european-union/index_en www.loc.gov/collections www.bl.uk/manuscripts www.si.edu/exhibitions
    www.bbc.com/news/world www.theguardian.com/science www.reuters.com/business www.npr.org/sections/books www.spiegel.de/wissenschaft www.lemonde.fr/culture elpais.com/ciencia www.nytimes.com/section/books apnews.com/hub/science www.dw.com/de/themen
    docs.python.org/3/library/os.html docs.oracle.com/javase/tutorial developer.mozilla.org/en-US/docs/Web/HTML www.w3.org/TR/html52 spark.apache.org/docs/latest www.postgresql.org/docs/current kubernetes.io/docs/concepts git-scm.com/book/en/v2 www.gnu.org/software/bash/manual go.dev/doc/effective_go
    stackoverflow.com/questions/11227809 math.stackexchange.com/questions/29450 github.com/apache/spark gitlab.com/gnachman/iterm2 news.ycombinator.com/item lobste.rs/newest www.kaggle.com/datasets huggingface.co/datasets pypi.org/project/numpy crates.io/crates/serde
    www.mit.edu/research ocw.mit.edu/courses/physics www.stanford.edu/academics www.ox.ac.uk/admissions www.cam.ac.uk/research www.ethz.ch/en/studies.html www.tum.de/studium www.sorbonne-universite.fr/formations www.uni-heidelberg.de/fakultaeten www.khanacademy.org/math/algebra
    www.allrecipes.com/recipe/10813/best-chocolate-chip-cookies www.bbcgoodfood.com/recipes/vegetable-soup www.seriouseats.com/bread-baking www.chefkoch.de/rezepte www.marmiton.org/recettes gardening.cornell.edu/homegardening www.rhs.org.uk/plants www.audubon.org/field-guide www.nationalgeographic.com/animals www.worldwildlife.org/species
    www.lonelyplanet.com/italy/rome www.deutschebahn.com/de/fahrplan www.nationalrail.co.uk/journey-planner www.tripsavvy.com/hiking-trails www.openstreetmap.org/about weather.com/forecast www.metoffice.gov.uk/climate earthobservatory.nasa.gov/images www.usgs.gov/faqs www.alpineclub.org.uk/guides
    www.metmuseum.org/art/collection www.louvre.fr/en/explore www.museodelprado.es/coleccion www.moma.org/artists www.tate.org.uk/art www.rijksmuseum.nl/en www.deutsches-museum.de/ausstellungen www.nhm.ac.uk/discover www.poetryfoundation.org/poems www.classical.net/music
    chess.org/openings www.fide.com/calendar www.olympics.com/en/sports www.uefa.com/news www.cyclingweekly.com/fitness www.runnersworld.com/training www.climbing.com/skills www.astronomy.com/observing skyandtelescope.org/stargazing www.amsat.org/status
    www.gov.uk/browse/education www.bund.de/verwaltung www.service-public.fr/particuliers www.irs.gov/forms-pubs www.courts.ca.gov/selfhelp www.cdc.gov/flu www.mayoclinic.org/diseases-conditions www.healthline.com/nutrition www.nhs.uk/conditions/asthma www.redcross.org/first-aid
    blog.rust-lang.org/2023/06/01 www.joelonsoftware.com/2000/08/09 martinfowler.com/articles/microservices.html jvns.ca/blog/2016 danluu.com/latency-mitigation aphyr.com/posts www.schneier.com/blog/archives lwn.net/Articles/250967 simonwillison.net/2023 research.google/pubs
    library.harvard.edu/collections www.worldcat.org/title openlibrary.org/works www.librarything.com/catalog www.goodreads.com/book/show www.jstor.org/stable plato.stanford.edu/entries/kant www.history.com/topics/ancient-rome www.ancient.eu/greece www.archaeology.org/issues
    forum.gardenersworld.com/threads forums.woodworking.org/topic community.home-assistant.io/t/energy discourse.julialang.org/t/arrays www.photo.net/learn www.dpreview.com/lenses www.trainweb.org/photos www.railwaymuseum.org.uk/visit www.sailing.org/worldcup www.knittinghelp.com/patterns
    linguistlist.org/issues www.omniglot.com/writing forvo.com/languages dict.leo.org/german-english www.wordreference.com/es www.duden.de/woerter www.larousse.fr/dictionnaires dle.rae.es/palabra www.etymonline.com/word tatoeba.org/en/sentences
""".split()


def labelled() -> list[tuple[str, str, int]]:
    """host, path, label (1 is unwanted) of the table; each URL's host with the root as its path too."""
    out = []
    for label, urls in ((1, UNWANTED), (0, WANTED)):
        for url in urls:
            host, _, path = url.partition("/")
            out += [(host, "/" + path, label), (host, "/", label)]
    return out


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ngrams(text: Column, mark: str) -> Column:
    """Character n-grams with the mark in front; the text's ends are marked."""
    full = F.concat(F.lit("^"), text, F.lit("$"))
    one = lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.length(full) - n + 1), lambda i: F.length(full) >= n), lambda i: F.concat(F.lit(mark), F.substring(full, i, F.lit(n))))
    return F.concat(*(F.when(F.length(full) >= n, one(n)).otherwise(F.array().cast("array<string>")) for n in SIZES))


def featured(df: DataFrame) -> DataFrame:
    grams = df.withColumn("__grams", F.concat(ngrams(F.col("host"), "h:"), ngrams(F.col("path"), "p:")))
    return HashingTF(inputCol="__grams", outputCol="__features", numFeatures=FEATURES, binary=True).transform(grams)


def fit(spark: SparkSession, rows: list[tuple[str, str, int]] | None = None):
    table = spark.createDataFrame(rows or labelled(), "host string, path string, label int").repartition(1)
    data = featured(table).cache()
    model = LogisticRegression(featuresCol="__features", labelCol="label", probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="__prediction", regParam=0.02, maxIter=30).fit(data)
    data.unpersist()
    return model


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that fits (as host and path), and its verdict; null without one."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    name = verdict = None
    for what, h, p in longest:
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return name, verdict


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the model's probability of being unwanted)."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    scored = fit(pages.sparkSession).transform(featured(split)).withColumn("score", F.round(vector_to_array("__probability")[1], 6))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    model = F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, model).alias("verdict"), "score")
