"""Fixed values of the domain: word lists, patterns, thresholds and lookup tables.

Every value here has to equal the published one for results to agree; each
stands in its natural order.
"""

from __future__ import annotations

# Words that carry no topic.
STOPWORDS = tuple("""
the a an and or but is are was were be been being have has had do does did will would could should may might
can of in on at to for with by from up about into through over after before as than this that these those i
you he she it we they them their there what which who when where why how all each every any some no not only
own same so very just also new now then says said say told according report reports reported reportedly amid
plans plan around despite including s t m d ve ll re
""".split())

# Named entities that anchor a narrative.
ANCHORS = (
    "usa", "britain", "iran", "russia", "china", "ukraine", "israel", "gaza", "lebanon", "taiwan",
    "north korea", "south korea", "japan", "india", "turkey", "saudi", "venezuela", "nato", "eu",
    "european union", "un", "trump", "biden", "putin", "hormuz", "tehran", "moscow", "beijing", "washington",
    "brussels", "kyiv", "fed", "federal reserve", "fomc", "ecb", "boj", "sec", "doj", "cftc", "treasury",
    "irs", "white house", "pentagon", "bitcoin", "ethereum", "binance", "coinbase", "kraken", "tether",
    "usdc", "usdt", "microstrategy", "blackrock", "fidelity", "war", "ceasefire", "tariff", "sanction",
    "hack", "exploit", "etf", "rate cut", "rate hike", "inflation", "cpi", "recession", "upgrade", "fork",
    "bankruptcy", "depeg", "evacuation", "embassy",
)

# Other names of anchors.
ALIASES = {
    "federal reserve": "fed", "fomc": "fed", "powell": "fed", "jerome powell": "fed", "us": "usa",
    "united states": "usa", "america": "usa", "american": "usa", "uk": "britain", "british": "britain",
    "united kingdom": "britain", "irgc": "iran", "khamenei": "iran", "ayatollah": "iran", "iranian": "iran",
    "hezbollah": "lebanon", "lebanese": "lebanon", "idf": "israel", "israeli": "israel",
    "netanyahu": "israel", "palestinian": "gaza", "tehran": "iran", "beijing": "china", "chinese": "china",
    "moscow": "russia", "russian": "russia", "kyiv": "ukraine", "ukrainian": "ukraine", "zelensky": "ukraine",
    "putin": "russia", "xi": "china", "north korean": "north korea", "south korean": "south korea",
    "japanese": "japan", "indian": "india", "turkish": "turkey", "saudi arabia": "saudi", "saudis": "saudi",
    "venezuelan": "venezuela", "european": "eu", "strait of hormuz": "hormuz", "european central bank": "ecb",
    "bank of japan": "boj", "securities and exchange commission": "sec", "department of justice": "doj",
    "white house": "usa", "btc": "bitcoin", "eth": "ethereum", "evacuate": "evacuation",
    "evacuations": "evacuation", "evacuating": "evacuation", "embassies": "embassy",
}

# Anchors that by themselves suggest one narrative.
CORE_ANCHORS = (
    "iran", "russia", "ukraine", "israel", "china", "gaza", "lebanon", "taiwan", "north korea", "venezuela",
    "fed", "sec", "ecb", "bitcoin", "ethereum",
)

# Anchors of the kind nation.
NATIONS = (
    "usa", "iran", "russia", "china", "ukraine", "israel", "gaza", "lebanon", "taiwan", "north korea",
    "south korea", "britain", "japan", "india", "turkey", "saudi", "venezuela", "trump", "biden", "putin",
)

# Anchors of the kind institution.
INSTITUTIONS = (
    "fed", "ecb", "boj", "fomc", "sec", "cftc", "doj", "treasury", "irs", "nato", "eu", "european union",
    "un", "white house", "pentagon",
)

# Anchors of the kind crypto.
CRYPTOS = tuple("""
bitcoin ethereum binance coinbase kraken tether usdc usdt microstrategy blackrock fidelity
""".split())

# Anchors of the kind action.
ACTIONS = (
    "war", "ceasefire", "tariff", "sanction", "hack", "exploit", "etf", "rate cut", "rate hike", "inflation",
    "cpi", "recession", "upgrade", "fork", "bankruptcy", "depeg", "evacuation", "embassy",
)

# Anchors of the kind location.
LOCATIONS = tuple("""
hormuz tehran moscow beijing washington brussels kyiv
""".split())

# Similarity levels and ages of narratives.
MATCH_LEVEL, CORE_MATCH_LEVEL = 0.40, 0.25
ACTIVE_HOURS, FADING_DAYS, STALE_DAYS = 24, 7, 30
TRACKED_CATEGORIES = ("geopolitical", "regulatory", "macro")

# Words left out of a story hash.
STORY_STOPWORDS = tuple("""
a an and or but the is are was were be been being to of in on at by for with from as this that these those it
its if then than so such no not only own same very just now also new after before amid into over under about
above below between through during since until says said say told according report reports reported reportedly
may might could should would will can has have had do does did all any each more most other some what which
who when where why how news update updates breaking exclusive
""".split())

# Sources of the first tier.
TIER1_DOMAINS = tuple("""
reuters.com bloomberg.com wsj.com nytimes.com ft.com economist.com washingtonpost.com ap.org apnews.com
bbc.com bbc.co.uk cnn.com nbcnews.com cbsnews.com abcnews.go.com theguardian.com telegraph.co.uk nikkei.com
scmp.com
""".split())

# Sources of the second tier.
TIER2_DOMAINS = tuple("""
cnbc.com marketwatch.com businessinsider.com forbes.com fortune.com axios.com politico.com thehill.com
independent.co.uk thetimes.co.uk lemonde.fr spiegel.de elpais.com japantimes.co.jp straitstimes.com
""".split())

# Escalation vocabulary and its weights.
CASCADE_WEIGHTS = {
    "unprecedented": 3.0, "no precedent": 3.0, "first time": 2.0, "no alternative": 3.0, "single source": 3.0,
    "irreplaceable": 3.0, "global": 1.5, "worldwide": 1.5, "international": 1.0, "supply chain": 2.5,
    "manufacturing": 2.0, "factory": 1.5, "longer than expected": 2.0, "worse than feared": 2.5,
    "system-wide": 2.5, "cascading": 3.0, "domino": 3.0, "longer recovery": 2.0, "no quick fix": 2.5,
    "spreading": 1.5, "expanding": 1.0, "broader": 1.0, "industry-wide": 2.0, "across": 0.5,
    "throughout": 0.5, "ripple effect": 2.0, "knock-on": 1.5, "sustained": 1.0, "prolonged": 1.5,
    "extended": 0.8, "concern": 0.5, "warning": 0.7, "risk": 0.5, "threat": 0.7, "pressure": 0.5,
    "strain": 0.7, "stress": 0.5, "uncertainty": 0.5, "uncertain": 0.5, "questions": 0.3, "fears": 0.7,
    "alarm": 1.0, "worry": 0.5,
}

# Whole words and the ticker each stands for.
TICKER_WORDS = {
    "bitcoin": "BTC", "btc": "BTC", "ethereum": "ETH", "eth": "ETH", "solana": "SOL", "sol": "SOL",
    "ripple": "XRP", "xrp": "XRP", "cardano": "ADA", "ada": "ADA", "polkadot": "DOT", "dot": "DOT",
    "cosmos": "ATOM", "atom": "ATOM", "dogecoin": "DOGE", "doge": "DOGE", "tron": "TRX", "trx": "TRX",
    "avalanche": "AVAX", "avax": "AVAX", "chainlink": "LINK", "link": "LINK", "uniswap": "UNI", "uni": "UNI",
    "aave": "AAVE", "litecoin": "LTC", "ltc": "LTC", "bnb": "BNB", "binance coin": "BNB",
    "stablecoin": "STABLE", "usdt": "USDT", "usdc": "USDC", "tether": "USDT",
}

# Weight of an impact level.
IMPACT_WEIGHTS = {
    "noise": 0.0, "low": 0.2, "medium": 0.5, "high": 1.0, "during_event": 0.3,
}

# Categories that tighten.
TIGHTEN_CATEGORIES = tuple("""
geopolitical macro regulatory
""".split())

# Categories that only react.
REACTIVE_CATEGORIES = tuple("""
technical_analysis price_commentary opinion promotion
""".split())

# Endings of leveraged tokens.
LEVERAGED_SUFFIXES = tuple("""
UPUSDT DOWNUSDT UPUSDC DOWNUSDC UPBUSD DOWNBUSD
""".split())

# Stable coins.
STABLE_BASES = tuple("""
USDC BUSD TUSD FDUSD USDP PAX DAI EUR GBP AUD TRY BRL RUB JPY IDR NGN ZAR UAH BIDR BKRW BVND
""".split())

# Coins whose name ends in B.
B_CRYPTO = tuple("""
BNB COMB ARB BLUR JOB GLMB
""".split())

# Category rules; the first rule with a matching pattern decides.
CATEGORY_RULES = (
    ("geopolitical", True, (
        r"""\b(war|ceasefire|sanction\w*|tariff\w*|embargo|invasion|missile|strike|military|troops)\b""",
        r"""\b(iran|russia|china|north korea|ukraine|israel|gaza|taiwan)\b.*\b(attack|threat|escalat\w*|conflict|war|strike)\b""",
        r"""\btrump\b.*\b(announc\w*|order\w*|sign\w*|tariff\w*|ban\w*|threaten\w*|impose\w*|deal)\b""",
        r"""\b(biden|xi|putin|kim jong)\b.*\b(announc\w*|threat|deal|summit)\b""",
        r"""\b(geopolit\w*|trade war|cold war|strait of hormuz)\b""",
        r"""\b(greenland|nato|liberation day|executive order)\b""",
        r"""\b(election|vote|inauguration)\b.*\b(crypto|bitcoin)\b""",
        r"""\b(embassy|embassies|consulate)\b.*\b(evacuat\w*|leave|withdraw|depart|close)\b""",
        r"""\b(evacuat\w*|urge\w*\s+(to\s+)?leave)\b.*\b(citizens|nationals|personnel|staff)\b""",
        r"""\b(citizens|nationals)\b.*\b(evacuat\w*|urged to leave)\b""",
        r"""\b(travel warning|travel advisory|do not travel)\b""",
        r"""\b(state department|foreign ministry)\b.*\b(warn\w*|evacuat\w*|advisory)\b""",
    )),
    ("regulatory", True, (
        r"""\b(sec |sec\b|sec's).*\b(approv\w*|reject\w*|sue\w*|charg\w*|investigat\w*|settlement|fine\w*|enforc\w*|file\w*|drop\w*)\b""",
        r"""\b(etf)\b.*\b(approv\w*|reject\w*|fil\w*|delay\w*|launch\w*|denied|greenlight\w*)\b""",
        r"""\b(spot|futures) (etf|bitcoin|ethereum)\b""",
        r"""\b(ban\w*|prohibit\w*|restrict\w*|outlaw\w*|crackdown)\b.*\b(crypto|bitcoin|mining|stablecoin|exchange)\b""",
        r"""\b(regulat\w*|legislat\w*|bill|law|act|framework|guideline|rule)\b.*\b(crypto|bitcoin|digital asset|stablecoin|blockchain)\b""",
        r"""\b(cftc|doj|fbi|treasury|ofac|fincen|irs|finra)\b.*\b(crypto|bitcoin|exchange|tax|enforcement)\b""",
        r"""\b(mica|clarity act|fit21|stablecoin act|genius act)\b""",
        r"""\b(coinbase|binance|kraken|tether|ripple)\b.*\b(sec|lawsuit|settlement|charged|fined)\b""",
        r"""\b(senate|congress|house|parliament|european union|eu)\b.*\b(crypto|bitcoin|stablecoin|digital asset)\b""",
        r"""\b(license|licensing|compliance|aml|kyc)\b.*\b(crypto|exchange|stablecoin)\b""",
        r"""\b(irs|tax)\b.*\b(crypto|bitcoin|staking|mining|defi)\b""",
    )),
    ("macro", True, (
        r"""\b(federal reserve|fed |the fed\b|fomc|powell|jerome powell)\b""",
        r"""\b(interest rate|rate cut|rate hike|rate decision|rate hold|basis point|bps)\b""",
        r"""\b(cpi|inflation|ppi|gdp|employment|payroll|jobless|unemployment|recession)\b""",
        r"""\b(dollar|dxy|treasury|yield|bond|10-year|2-year)\b.*\b(surge\w*|crash\w*|spike\w*|plunge\w*|soar\w*|rise\w*|fall\w*)\b""",
        r"""\b(quantitative|qt|qe|tightening|easing|hawkish|dovish)\b""",
        r"""\b(nasdaq|s&p|spx|dow jones|stocks)\b.*\b(crash\w*|plunge\w*|rally\w*|correlation|bitcoin)\b""",
        r"""\b(ecb|boe|boj|pboc)\b.*\b(rate|policy|decision)\b""",
        r"""\b(gold|oil|commodity)\b.*\b(bitcoin|crypto|correlation|safe haven)\b""",
        r"""\b(debt ceiling|budget|fiscal|monetary policy)\b""",
    )),
    ("exchange_event", True, (
        r"""\b(hack\w*|exploit\w*|breach\w*|stolen|drain\w*)\b""",
        r"""\b(rug pull|rugpull|scam|fraud|ponzi)\b""",
        r"""\b(insolvenc\w*|bankrupt\w*|collapse\w*|shut down|shutdown|halt\w*|suspend\w*|freeze\w*|frozen)\b""",
        r"""\b(binance|coinbase|kraken|okx|bybit|ftx|gemini|bitfinex|huobi|mexc|bitget|upbit|bitstamp)\b.*\b(halt\w*|suspend\w*|paus\w*|investigat\w*|charg\w*|sue\w*|hack\w*|exploit\w*|withdraw\w*|outflow\w*|insolven\w*)\b""",
        r"""\b(withdraw\w*)\b.*\b(halt\w*|suspend\w*|paus\w*|freeze\w*|disabl\w*|unable|issue|delay\w*)\b""",
        r"""\b(depeg\w*|lost peg|off peg)\b""",
        r"""\b(luna|terra|ust|celsius|voyager|genesis|three arrows|3ac)\b.*\b(crash\w*|collapse\w*|depeg\w*|bankrupt\w*)\b""",
        r"""\b(liquidat\w*)\b.*(\$\d+|billion|million|cascade|wave)""",
        r"""(\$\d+\s*(m|b|million|billion))\b.*\b(liquidat\w*|wiped|flash crash)\b""",
        r"""\b(wiped|wipes)\b.*\$\d+""",
        r"""\b(flash crash|flash loan attack)\b""",
    )),
    ("whale_flow", True, (
        r"""\b(whale|whales)\b.*\b(buy|sell|bought|sold|dump\w*|accumul\w*|transfer\w*|mov\w*|deposit\w*|withdraw\w*)\b""",
        r"""\b(mt\.?\s*gox|silk road|government|us govt|german govt)\b.*\b(transfer\w*|mov\w*|send|sell|btc|bitcoin)\b""",
        r"""\b(etf)\b.*\b(inflow\w*|outflow\w*|redeem\w*|billion|million|net)\b""",
        r"""\b(tether|usdt|usdc|dai)\b.*\b(mint\w*|burn\w*|print\w*|issu\w*|supply)\b""",
        r"""\b(\d+,?\d*\s*btc|\d+k\s*btc|\d+,?\d*\s*eth)\b.*\b(transfer\w*|mov\w*|sold|bought)\b""",
        r"""\b(institutional|microstrategy|strategy|blackrock|fidelity)\b.*\b(buy\w*|bought|purchase\w*|accumul\w*|sell\w*|sold)\b.*\b(bitcoin|btc|eth)\b""",
        r"""\b(treasury|corporate)\b.*\b(bitcoin|btc)\b.*\b(purchase\w*|acqui\w*|buy\w*|sell\w*|bought|sold)\b""",
    )),
    ("protocol", True, (
        r"""\b(upgrade\w*|hard fork|soft fork|merge|pectra|dencun|shanghai|cancun|prague)\b""",
        r"""\b(vulnerability|exploit\w*|bug|critical)\b.*\b(found|discover\w*|patch\w*|fix\w*|disclos\w*)\b""",
        r"""\b(ethereum|bitcoin|solana|avalanche|cardano)\b.*\b(network|outage|down|halt\w*|congest\w*)\b""",
        r"""\b(halving|halvening)\b""",
        r"""\b(mainnet|testnet)\b.*\b(launch\w*|deploy\w*|live|go live)\b""",
        r"""\b(consensus|validator|staking)\b.*\b(change\w*|update\w*|vulnerability)\b""",
        r"""\b(51% attack|double spend)\b""",
    )),
    ("technical_analysis", False, (
        r"""\btechnical analysis\b""",
        r"""\b(rsi|macd|bollinger|fibonacci|moving average|support resistance|support and resistance|sma|ema)\b""",
        r"""\b(bull flag|bear flag|head and shoulders|double top|double bottom|wedge|triangle|pennant|cup and handle)\b""",
        r"""\b(overbought|oversold|momentum indicator|divergence)\b""",
        r"""\b(chart|pattern)\b.*\b(show\w*|suggest\w*|signal\w*|indicat\w*|form\w*|reveal\w*)\b""",
        r"""\b(breakout|breakdown|retest)\b.*\b(above|below|level|resistance|support)\b""",
        r"""\b(key level|key support|key resistance|critical level)\b""",
        r"""\b(ta|tech analysis)\b""",
        r"""\b(golden cross|death cross)\b""",
    )),
    ("price_commentary", False, (
        r"""\bprice prediction\b""",
        r"""\b(could|may|might|will|can|would)\b.*\b(reach|hit|surge|pump|moon|rally|touch|target)\b.*\$\d+""",
        r"""\b(could|may|might|will)\b.*\b(reach|hit)\b.*\$""",
        r"""\b(analyst\w*|expert\w*|trader\w*|strategist\w*)\b.*\b(say\w*|predict\w*|forecast\w*|expect\w*|believ\w*|think\w*|see|target\w*)\b""",
        r"""\b(bull case|bear case|price target|prediction|outlook|forecast)\b""",
        r"""\b(why|what|how)\b.*\b(bounc\w*|crash\w*|fall\w*|ris\w*|drop\w*|pump\w*|dump\w*|surg\w*|rally\w*)\b""",
        r"""\b(here's why|this is why|reasons why)\b""",
        r"""\$\d+k?\b.*\b(possible|likely|incoming|imminent|soon)\b""",
        r"""\b(mooning|to the moon|next stop|eyeing)\b.*\$\d+""",
        r"""\b(price action|daily close|weekly close)\b""",
        r"""\b(target|targets|targeting)\b.*\$\d+""",
    )),
    ("opinion", False, (
        r"""\b(opinion|editorial|column|commentary|op-ed|take|perspective|viewpoint)\b""",
        r"""\b(i think|we believe|in my view|it seems|arguably|undoubtedly)\b""",
        r"""\b(should you|is it time|is it worth|should i|why i|how i)\b""",
        r"""\b(explained|explainer|guide to|beginner's guide)\b""",
        r"""\b(vs\.?|versus)\b.*\b(which|better|comparison)\b""",
    )),
    ("promotion", False, (
        r"""\b(airdrop|giveaway|presale|ico|ieo|ido|launchpad)\b""",
        r"""\b(memecoin|meme coin|shib|pepe|bonk|wif|floki)\b""",
        r"""\b(100x|1000x|10000x|\dx gains?|massive gains?)\b""",
        r"""\b(best crypto|top crypto|crypto to buy|next big|hidden gem|hidden gems)\b""",
        r"""\b(top \d+|best \d+|\d+ altcoins? to|\d+ coins to)\b.*\b(buy|watch|hold|invest|gain)\b""",
        r"""\b(sponsored|partner|ad|advertisement|promoted)\b""",
        r"""\b(new memecoin|trending memecoin|rocket|gem alert)\b""",
        r"""\b(gains? of \d+%|pumped \d+%|up \d\d\d+%|gains \d+%)\b""",
    )),
)

# Verb categories: direction, weight, lemmas, lemmas that are nouns as well.
VERBS = {
    "ATTACKS": ("escalation", 1.0, "attack strike bomb fire launch threaten intimidate warn menace challenge sue kill disrupt accuse escalate intensify retaliate breach violate", "charge"),
    "DEFENDS": ("escalation", 0.6, "defend protect guard shield fortify secure reinforce deploy", ""),
    "OPENS": ("de-escalation", 1.0, "open reopen restore resume release free ease clear", ""),
    "CLOSES": ("escalation", 1.0, "close shut block halt suspend restrict ban blockade", ""),
    "ANNOUNCES": ("neutral", 0.5, "announce declare confirm approve proclaim reveal disclose say show", "report signal note"),
    "RESCINDS": ("context-dependent", 0.7, "rescind cancel revoke withdraw reverse abandon drop scrap", ""),
    "IMPOSES": ("escalation", 0.9, "impose enforce apply introduce levy implement sanction freeze seize intercept arrest detain", "target place"),
    "LIFTS": ("de-escalation", 0.9, "lift remove end terminate dismiss eliminate abolish", ""),
    "DEMANDS": ("escalation", 0.7, "demand require insist press pressure call urge", ""),
    "AGREES": ("de-escalation", 0.8, "agree accept endorse ratify consent", "sign draft back"),
    "REJECTS": ("escalation", 0.8, "reject refuse deny decline rebuff spurn fail condemn", ""),
    "MEETS": ("de-escalation", 0.5, "meet discuss negotiate talk confer consult", ""),
}
# Assets that a category's events are watched on; other categories take the default.
DEFAULT_ASSETS = ("BTC", "ETH")
ROUTES = {
    "geopolitical": ("WTI", "GOLD"), "macro": ("BTC", "ETH", "WTI", "GOLD"), "regulatory": ("BTC", "ETH"), "exchange_event": ("BTC", "ETH"),
    "whale_flow": ("BTC", "ETH"), "protocol": ("BTC", "ETH"),
    "technical_analysis": (), "price_commentary": (), "opinion": (), "promotion": (), "uncategorized": (),
}

# Symbols of the rotation universe.
UNIVERSE = tuple("""
BTCUSDT ETHUSDT BNBUSDT SOLUSDT XRPUSDT ADAUSDT AVAXUSDT LINKUSDT DOTUSDT LTCUSDT ATOMUSDT
""".split())
