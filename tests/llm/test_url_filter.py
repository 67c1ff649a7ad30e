import re

import pytest

from factloom.llm import url_filter

URLS = [
    "http://A.Example.NET/en/1?x=/de/#y", "https://example.net/en/", "https://example.net/en", "https://sub.example.com/de/x", "https://myexample.com/de/x", "http://x.org/fr/1", "http://org/fr/",
    "http://x.org?/fr/", "net/", "http://net/", "http://net", "http://x.net#/", None, "", "://", "a://b://c/d", "http://cheap-pills.example.com/en/450?page=2", "http://www.free-bets.example.org/en/1",
    "http://ththre.example.com/fr/825", "http://é.example.com/ü", "http://" + "a." * 300 + "com/" + "p/" * 2000, "http://a/b\nc?d",
]


def parts(url):
    m = re.match(r".*?://([^/?#]*)([^?#]*)", url or "", re.S)
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def rule(host, path):
    fits = []
    for verdict, text in url_filter.RULES:
        domain, _, start = text.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start):
            fits.append((len(text), text, verdict))
    return max(fits)[1:] if fits else (None, None)


@pytest.fixture(scope="module")
def got(spark):
    rows = [(i, u, "x", 1.0, 2) for i, u in enumerate(URLS)] + [(None, URLS[0], "x", 1.0, 2), (0, URLS[0], "x", 1.0, 2)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, probability double, rule int").repartition(3)
    assert url_filter.filter_urls(pages.limit(0)).collect() == []
    return url_filter.filter_urls(pages).collect()


def test_parts_and_rules(got):
    assert len(got) == len(URLS) + 2
    for r in got:
        host, path = parts(URLS[r.page_id or 0])
        name, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, name)
        assert verdict in (None, r.verdict)


#: hosts written down before the model was first fitted on its table, never used for fitting nor to choose a parameter
UNWANTED = """bet365.com betway.com www.slotmachine.io luckyspins.net pokerstars-bonus.com onlinecasinos.eu blackjack21.net bingohall.co lotto-jackpot.ru
sportsbetting24.com roulette-system.com gamblingpro.biz www.vegas-slots.org baccarat-online.com jackpot-party.net freespins.club casinoroyale.bet oddsmaker.ag
betting-expert.io crapsonline.net xvideos.com pornhub.com xhamster.com redtube.com youporn.com sexchat.live camgirls.tv milfhunter.com nudes-leaked.com hentaihaven.org
eroticmassage-escorts.com xxxmovies.net livesexcams.com adultfriendfinder.com teenporn.cc sexshop-toys.biz bdsm-fetish.net swingersclub.com hotsingles.date pornpics.de
viagra-online.ru cheapcialis.com canadianpharmacy.net rxdrugs-online.com buyxanax.org steroids4u.com weightlosspills.shop dietmiracle.biz ketogummies.info
tramadol-cheap.com genericmeds24.com pharmacy-noprescription.com malemenhancement.net thepiratebay.org torrentz2.eu crackwatch.net keygens.ru warezforum.cc nulled.to
serialkeys.org crackstreams.io fullcracked.com 1337x.torrents.ws apkmod-unlimited.com gamehacks-cheats.com replica-handbags.cn fakerolex.co counterfeit-money.shop
gucci-outlet.biz fake-passport.org diploma-mill.com replicasneakers.ru paydayloan-fast.com instantcash-loans.net badcreditloan.biz quickloans.info
bitcoindoubler.net crypto-giveaway.io forex-profits.biz binaryoptions-signals.com earn-money-online.click hyipmonitor.biz ethereum-airdrop.claims
paypal-verify-login.com appleid-account-alert.com bank-signin-update.info amazon-prize-winner.com iphone-giveaway.club virus-scan-alert.net
flash-update-download.com pc-speedup-cleaner.biz adserver.clicks.com popads.net banner-exchange.biz buy-backlinks.net instagram-followers-buy.com seo-linkfarm.biz
trafficbots.net bulk-email-leads.com essay-writing-cheap.com clickbait-redirect.top""".split()
WANTED = """gitlab.com www.cnn.com www.zeit.de www.oxfordjournals.org numpy.org www.metmuseum.org www.elmundo.es www.cam.ac.uk debian.org www.meteofrance.fr
wikidata.org commons.wikimedia.org www.economist.co.uk www.faz.net www.lefigaro.fr www.repubblica.it www.nhk.or.jp www.abc.net.au www.cbc.ca www.npr.org
www.science.org www.cell.com www.pnas.org www.jstor.org plos.org www.esa.int www.cern.ch www.noaa.gov www.usgs.gov www.epa.gov www.cdc.gov www.nih.gov www.un.org
www.unesco.org www.oecd.org www.imf.org data.worldbank.org www.parliament.uk www.bundestag.de www.senat.fr www.congress.gov www.cityofchicago.org www.berlin.de
www.harvard.edu www.yale.edu www.princeton.edu www.ethz.ch www.tum.de www.sorbonne-universite.fr www.uam.es www.khanacademy.org www.coursera.org www.duolingo.com
www.r-project.org www.haskell.org www.julialang.org go.dev www.php.net nodejs.org pandas.pydata.org pytorch.org www.tensorflow.org www.mozilla.org www.redhat.com
www.vogelwarte.ch www.kew.org www.zoo-berlin.de www.aquarium.org www.rijksmuseum.nl www.moma.org www.guggenheim.org www.philharmonie.de www.operadeparis.fr
www.foodnetwork.com www.bonappetit.com www.chefkoch.de www.seriouseats.com www.runnersworld.com www.climbing.com www.sailingmagazine.net www.trainspotting.co.uk
www.lonelyplanet.com www.sncf.com www.renfe.com www.deutschebahn.com www.airbus.com www.siemens.com www.toyota.com www.lego.com www.librarything.com
www.poetryfoundation.org www.bookdepository.com www.penguin.co.uk www.cambridge.org www.springer.com www.wiley.com www.mayoclinic.org www.redcross.org
www.amnesty.org www.greenpeace.org www.scouts.org.uk""".split()


def verdicts(spark, hosts, path=""):
    pages = spark.createDataFrame([(i, f"https://{h}{path}") for i, h in enumerate(hosts)], "page_id bigint, url string")
    judged = url_filter.filter_urls(pages, spark.createDataFrame([("allow", "none/")], "verdict string, rule string"))
    return {hosts[r.page_id]: r.verdict for r in judged.collect()}


def test_hosts_the_table_does_not_have(spark):
    fitted = {url_filter.host_of(u) for u in url_filter.ALLOWED + url_filter.BLOCKED}
    assert len(UNWANTED) >= 100 and len(WANTED) >= 100 and not fitted & {*UNWANTED, *WANTED}
    bad, good = verdicts(spark, UNWANTED, "/"), verdicts(spark, WANTED, "/")
    assert sum(v == "block" for v in bad.values()) >= 0.8 * len(bad)
    assert sum(v == "allow" for v in good.values()) >= 0.95 * len(good)


def test_the_fitted_table_is_learned(spark):
    told = verdicts(spark, [u.split("://")[1] for u in url_filter.ALLOWED + url_filter.BLOCKED])
    wrong = [h for h, v in told.items() if v != ("allow" if "https://" + h in url_filter.ALLOWED else "block")]
    assert len(wrong) <= 2, wrong
