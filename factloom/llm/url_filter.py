"""URL filter: rules by host and path, and logistic regression on hashed character n-grams for what no rule fits.

Everything runs over distinct URLs: a host or URL in a third of all rows is looked up and scored once.
Rules are joined by the host's suffixes, so there may be as many as one likes. The model is
Spark's logistic regression, trained from a small labelled table of URLs; its weights are a vector of fixed length.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.tables import join_rows, save

SIZES = (3, 4, 5)
FEATURES = 1 << 14
#: probability from which on the model blocks; a URL that it is unsure of passes
BLOCK_FROM = 0.7
#: (verdict, rule)
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Places by which people label URLs, wanted and unwanted ones, written down by subject (news, schools, software, ...; gambling, sex,
#: medicines, cracked software, counterfeits, loans, fraud, advertising) without a word or path of the given pages.
ALLOWED = [f"https://{place}" for place in """
github.com/torvalds/linux en.wikipedia.org/wiki/Water de.wikipedia.org/wiki/Wetter www.bbc.co.uk/news/world www.nytimes.com/section/science
stackoverflow.com/questions/11227809 docs.python.org/3/library/index.html www.nature.com/articles/s41586 arxiv.org/abs/1706.03762 www.lemonde.fr/planete/article
www.spiegel.de/wissenschaft/12 elpais.com/cultura/2024-05 www.nasa.gov/missions/artemis www.who.int/health-topics/nutrition www.mit.edu/research/
www.uni-heidelberg.de/de/studium www.gutenberg.org/ebooks/1342 archive.org/details/texts www.britannica.com/science/atom www.allrecipes.com/recipe/soup
www.marmiton.org/recettes/tarte www.weather.gov/forecast/today www.openstreetmap.org/way/77 kernel.org/doc/html/latest/ www.gnu.org/software/make/manual.html
developer.mozilla.org/docs/Web news.ycombinator.com/item?id=8 www.theguardian.com/books/2023 www.louvre.fr/explore www.britishmuseum.org/collection
www.loc.gov/collections/maps/ www.europa.eu/youth www.bahn.de/service/fahrplan www.imdb.com/title/tt0111161 www.goodreads.com/book/show/5107
blog.rust-lang.org/2024/02/index.html www.rhs.org.uk/plants/roses www.nationalgeographic.com/history www.cityofboston.gov/parks/ www.stanford.edu/admission/
forum.ubuntu-fr.org/viewtopic.php www.chess.com/learn/openings www.ikea.com/tables www.mathworld.com/Theorem.html www.tate.org.uk/art/11
reuters.com/world/europe www.washingtonpost.com/science www.history.com/topics/rome theatlantic.com/ideas medium.com/design/typography
www.smithsonianmag.com/nature recipes.timesofindia.com/curry www.postgresql.org/docs/16/ www.heise.de/developer www.inria.fr/recherche
www.rtve.es/noticias www.ted.com/talks www.ox.ac.uk/admissions apache.org/foundation www.wikivoyage.org/wiki/Lisbon
www.zdf.de/dokumentation www.dwd.de/wetter scipy.org/install www.sciencejournals.org/volume/60 www.museodelprado.es/coleccion
www.libraryofwales.org/catalogue www.ucl.ac.uk/lectures getfedora.org/workstation www.meteo.fr/previsions www.orchestra.org/concerts
www.tagesschau.de/inland www.oreilly.com/library www.schoolofmusic.org/lessons gardenersworld.com/plants/tomato www.astronomynow.com/saturn
www.biologycorner.com/worksheets hikingproject.com/trail/700 www.townhall.gov.uk/council www.kindergarten-sonnenschein.de/eltern www.boulangerie-martin.fr/horaires
www.fotografia-clasica.es/galeria www.railwaymuseum.org.uk/visit cyclingclub.org/routes www.volunteers.org/join-us www.parentsmagazine.com/toddlers
www.economist.com/finance www.legislation.gov.uk/ukpga/1998 www.birdwatching.org/species www.woodworkersguild.com/joints www.opera-bastille.fr/saison
www.apothekerkammer.de/notdienst www.hospital-clinic.es/pacientes www.cancerresearch.org/trials www.teachersunion.org/contracts www.bankofengland.co.uk/statistics
www.sportsmedicine.edu/journal www.lawreview.edu/issues/12 www.cardgames-rules.org/bridge www.videoarchive.org/film/silent www.languagelearning.com/grammar
""".split()]
BLOCKED = [f"https://{place}" for place in """
royalslots777.com/spin www.jackpotcity-bonus.net/join onlineroulette.bet/live www.pokerking.co/deposit blackjack-lounge.com/signup
bingo-billions.com/play www.sportsbook-odds.ag/betting lottery-jackpots.info/tickets vegas-gambling.io/register www.megaslots.club/bonus
betting-tips-sure.com/odds www.baccarat-live.asia/table spinpalace-slots.com/welcome bookmaker-bonus.eu/betting www.gamblers-lounge.com/roulette
pornvideos-hd.com/watch www.xxxclips.tv/hot sexcams-live.com/chat www.hotmilfs.net/pics nudegirls-cam.com/live
escorts-tonight.com/city www.hentai-tube.org/video eroticstories.cc/new sexdating-local.com/meet www.pornstars.xxx/gallery
www.lesbian-porn.net/clip fetish-cams.com/rooms hookup-singles.com/tonight www.swingers-sex.com/party amateur-xxx.net/upload
buyviagra-online.com/order www.cialis-generic.net/buy rxmeds-nodoctor.com/checkout www.onlinepharmacy-discount.com/tablets xanax-overnight.biz/order
steroids-shop.org/anabolic www.slimming-tablets.com/trial weightloss-miracle.info/offer cbd-gummies-deal.com/buy www.tramadol-noprescription.com/cart
www.enlargement-secrets.com/order hairgrowth-miracle.com/trial modafinil-rx.net/cart www.diet-keto-miracle.com/buy painmeds-express.com/checkout
torrentking.cc/download www.crackedsoftware.org/keygen warez-portal.net/serial www.nulledscripts.to/themes fullversion-crack.com/activator
www.keygen-depot.com/serial movies-torrent.ws/stream apk-modded.club/unlimited www.serialz-crack.net/patch hacktools-download.com/cheats
replica-watches.cn/rolex www.fakebags-luxury.com/outlet counterfeit-id.com/passport www.replicashoes.ru/sale buyfakediploma.com/degree
www.louisvuitton-outlet-sale.com/bags rolex-replicas.co/discount www.designer-knockoffs.com/store fakedocuments-shop.com/license raybans-outlet.us/sale
paydayloans-instant.com/apply www.badcredit-loans.net/approved quickcash-advance.com/apply debtfix-now.info/offer www.instantloan24.com/nocheck
bitcoin-doubler.io/invest www.cryptoprofit-bot.com/deposit forexmillionaire.biz/signals www.earnmoney-home.com/start getrich-binaryoptions.com/trade
www.hyip-invest.com/profit passiveincome-secret.com/join airdrop-claim-eth.com/wallet www.doublecoins.cc/send makemoney-surveys.com/cash
secure-paypa1-login.com/verify www.appleid-verify.info/account bank-update-alert.com/signin www.account-suspended.net/confirm netflix-billing-update.com/pay
www.prizewinner-claim.com/iphone giveaway-samsung.club/claim www.virus-warning-alert.com/scan pc-cleaner-download.com/fix flashplayer-update.info/install
www.popunder-clicks.com/serve clickbanner-network.com/redirect www.backlinks-seo-packages.com/order buyfollowers-instagram.net/likes www.linkexchange-seo.biz/submit
bulkmailer-leads.com/lists www.essaywriting-service.biz/order getlikes-instant.com/buy www.traffic-bot.net/clicks doorway-redirect.biz/go
""".split()]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return (F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(path, F.lit("")))


def host_of(url: str) -> str:
    return url.partition("://")[2].partition("/")[0]


def rules_table(spark, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """(verdict, rule) as a frame of literals."""
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules))))


def labelled_urls(spark) -> DataFrame:
    """(url, label): 1.0 for unwanted ones."""
    return spark.range(1).select(F.inline(F.array(*(
        F.struct(F.lit(u).alias("url"), F.lit(label).alias("label")) for label, urls in ((0.0, ALLOWED), (1.0, BLOCKED)) for u in urls))))


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, marked by which they are of."""
    def runs(letters, mark, n):
        return F.when(F.size(letters) >= n, F.transform(
            F.sequence(F.lit(0), F.size(letters) - n), lambda i: F.concat(F.lit(mark), *(F.get(letters, i + j) for j in range(n)))))

    def of(mark, text):
        letters = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
        none = F.array().cast("array<string>")
        return F.get(F.transform(F.array(letters), lambda c: F.concat(
            *(F.coalesce(runs(c, mark, n), none) for n in SIZES))), F.lit(0))

    return F.concat(of("h:", host), of("p:", path))


def train(labelled: DataFrame) -> PipelineModel:
    """Of ``labelled`` (url, label), a small table: presence of hashed n-grams, ridge penalty."""
    host, path = host_and_path(F.col("url"))
    rows = save(labelled.select("label", grams(host, path).alias("grams")).coalesce(1), "labelled-urls")
    return Pipeline(stages=[
        HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True),
        LogisticRegression(regParam=0.05, maxIter=40)]).fit(rows)


def best_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, verdict): of the rules that fit the host or a parent domain and begin the path, the longest."""
    parts = rules.where("rule is not null").select("rule", "verdict", F.substring_index("rule", "/", 1).alias("domain")).withColumn(
        "start", F.substr("rule", F.length("domain") + 1))
    labels = F.split("host", r"\.")
    suffixes = F.get(F.transform(F.array(labels), lambda p: F.transform(
        F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), "."))), F.lit(0))
    return (
        urls.select("url", "path", F.explode(suffixes).alias("domain")).join(parts, "domain").where(F.startswith("path", "start"))
        .groupBy("url").agg(F.max(F.struct(F.length("rule").alias("length"), "rule", "verdict")).alias("best"))
        .select("url", "best.rule", "best.verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, blocked_probability.

    ``rule`` is the longest that fits, else null; the verdict is the rule's, else block from ``BLOCK_FROM`` on. A null url, or one
    without ``://``, has empty host and path and gets the model's verdict of an empty URL. Repeated rows
    get the same result each; other columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    model = train(labelled_urls(spark) if labelled is None else labelled)
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    urls = save(pages.select("url").distinct().withColumns({"host": host, "path": path}), "urls")
    scored = model.transform(urls.withColumn("grams", grams(F.col("host"), F.col("path"))))
    chance = F.get(vector_to_array("probability"), F.lit(1))
    ruled = join_rows(scored.select("url", "host", "path", chance.alias("blocked_probability")),
                      best_rules(urls, rules_table(spark) if rules is None else rules), ["url"])
    judged = ruled.withColumn("verdict", F.coalesce("verdict", F.when(F.col("blocked_probability") >= BLOCK_FROM, "block").otherwise("allow")))
    return join_rows(pages, judged, ["url"], "inner").select("page_id", "host", "path", "rule", "verdict", "blocked_probability")
