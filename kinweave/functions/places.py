"""Fixed values of addresses: short forms, words that are dropped, states and regions with their codes."""

from __future__ import annotations

#: The short form of address words.
ABBREVIATIONS = {
    # street types and directions
    "street": "st", "str": "st", "saint": "st", "avenue": "ave", "av": "ave", "road": "rd", "drive": "dr", "boulevard": "blvd", "boul": "blvd", "bd": "blvd",
    "lane": "ln", "court": "ct", "cove": "cv", "place": "pl", "terrace": "ter", "circle": "cir", "highway": "hwy", "parkway": "pkwy", "trail": "trl", "square": "sq",
    "point": "pt", "mount": "mt", "fort": "ft", "north": "n", "south": "s", "east": "e", "west": "w", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw",
    "apartment": "apt", "suite": "ste", "floor": "fl", "building": "bldg", "unit": "unit", "route": "rte", "expressway": "expy", "freeway": "fwy", "crossing": "xing",
    "heights": "hts", "junction": "jct", "center": "ctr", "centre": "ctr", "plaza": "plz", "ridge": "rdg", "village": "vlg", "township": "twp", "county": "cnty",
    # India
    "near": "nr", "opposite": "opp", "number": "no", "nagar": "ngr", "colony": "colony", "sector": "sec", "phase": "ph", "district": "dist", "taluka": "tal", "tq": "tal",
    "post": "po", "marg": "marg", "house": "h", "hno": "h", "flat": "flat", "plot": "plot", "door": "door", "dno": "door", "flno": "flat", "ground": "gr",
    "first": "1st", "second": "2nd", "third": "3rd",
    # France
    "rue": "rue", "r": "rue", "allee": "all", "impasse": "imp", "chemin": "ch", "chem": "ch", "lotissement": "lot", "residence": "res", "faubourg": "fbg", "quai": "qu",
    "cours": "crs", "passage": "pass", "promenade": "prom", "sainte": "ste",
}
#: Address words without meaning.
DROPPED = ["null", "none", "na", "nan", "the", "of", "c", "o"]
#: The states of the US by code.
US_STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut", "de": "delaware", "fl": "florida",
    "ga": "georgia", "hi": "hawaii", "id": "idaho", "il": "illinois", "in": "indiana", "ia": "iowa", "ks": "kansas", "ky": "kentucky", "la": "louisiana", "me": "maine",
    "md": "maryland", "ma": "massachusetts", "mi": "michigan", "mn": "minnesota", "ms": "mississippi", "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada",
    "nh": "new hampshire", "nj": "new jersey", "nm": "new mexico", "ny": "new york", "nc": "north carolina", "nd": "north dakota", "oh": "ohio", "ok": "oklahoma",
    "or": "oregon", "pa": "pennsylvania", "ri": "rhode island", "sc": "south carolina", "sd": "south dakota", "tn": "tennessee", "tx": "texas", "ut": "utah", "vt": "vermont",
    "va": "virginia", "wa": "washington", "wv": "west virginia", "wi": "wisconsin", "wy": "wyoming", "dc": "district of columbia", "pr": "puerto rico",
}
#: The states of India by name, with names that are not sound-alikes of the English one.
INDIA_STATES = {
    "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br", "chhattisgarh": "cg", "goa": "ga", "gujarat": "gj", "haryana": "hr",
    "himachal pradesh": "hp", "jharkhand": "jh", "karnataka": "ka", "kerala": "kl", "keralam": "kl", "madhya pradesh": "mp", "maharashtra": "mh", "manipur": "mn",
    "meghalaya": "ml", "mizoram": "mz", "nagaland": "nl", "odisha": "od", "orissa": "od", "punjab": "pb", "rajasthan": "rj", "sikkim": "sk", "tamil nadu": "tn",
    "tamilnadu": "tn", "telangana": "ts", "tripura": "tr", "uttar pradesh": "up", "uttarakhand": "uk", "uttaranchal": "uk", "west bengal": "wb", "delhi": "dl",
    "new delhi": "dl", "jammu and kashmir": "jk", "ladakh": "la", "chandigarh": "ch", "puducherry": "py", "pondicherry": "py", "andaman and nicobar islands": "an",
    "lakshadweep": "ld", "dadra and nagar haveli and daman and diu": "dn", "paschimbanga": "wb", "pashchimbanga": "wb", "paschim banga": "wb", "pscimbng": "wb",
    "bangla": "wb", "dilli": "dl", "nct of delhi": "dl", "odisa": "od",
}
#: Codes that stand for Indian states, and codes that mean another one.
INDIA_CODES = "ap ar as br cg ct ga gj hr hp jh ka kl mp mh mn ml mz nl od or pb rj sk tn ts tg tr up uk ut wb dl jk ch py an ld dn".split()
INDIA_ALIASES = {"ct": "cg", "or": "od", "tg": "ts", "ut": "uk"}
#: The regions of France with their former names and departements.
FRANCE_REGIONS = {
    "ara": "auvergne rhone alpes, rhone alpes, auvergne, ain, allier, ardeche, cantal, drome, isere, loire, haute loire, puy de dome, rhone, savoie, haute savoie, metropole de lyon",
    "bfc": "bourgogne franche comte, bourgogne, franche comte, cote d or, doubs, jura, nievre, haute saone, saone et loire, yonne, territoire de belfort",
    "bre": "bretagne, cotes d armor, finistere, ille et vilaine, morbihan",
    "cvl": "centre val de loire, cher, eure et loir, indre, indre et loire, loir et cher, loiret",
    "cor": "corse, corse du sud, haute corse",
    "ges": "grand est, alsace, lorraine, champagne ardenne, ardennes, aube, marne, haute marne, meurthe et moselle, meuse, moselle, bas rhin, haut rhin, vosges",
    "hdf": "hauts de france, nord pas de calais, picardie, aisne, nord, oise, pas de calais, somme",
    "idf": "ile de france, paris, seine et marne, yvelines, essonne, hauts de seine, seine saint denis, val de marne, val d oise",
    "nor": "normandie, haute normandie, basse normandie, calvados, eure, manche, orne, seine maritime",
    "naq": "nouvelle aquitaine, aquitaine, poitou charentes, limousin, charente, charente maritime, correze, creuse, dordogne, gironde, landes, lot et garonne, pyrenees atlantiques, deux sevres, vienne, haute vienne",
    "occ": "occitanie, midi pyrenees, languedoc roussillon, ariege, aude, aveyron, gard, haute garonne, gers, herault, lot, lozere, hautes pyrenees, pyrenees orientales, tarn, tarn et garonne",
    "pdl": "pays de la loire, loire atlantique, maine et loire, mayenne, sarthe, vendee",
    "pac": "provence alpes cote d azur, paca, alpes de haute provence, hautes alpes, alpes maritimes, bouches du rhone, var, vaucluse",
}


def state_codes(country: str) -> dict[str, str]:
    """What a whole address component has to read to be a state, and its code, for US, India or any other country.

    US: names and codes. India: names and codes. Others: French regions and departements, then US and Indian names.
    """
    us, india = {name: code for code, name in US_STATES.items()}, dict(INDIA_STATES)
    if country == "US":
        return {code: code for code in US_STATES} | us
    if country == "India":
        return {c: INDIA_ALIASES.get(c, c) for c in INDIA_CODES} | india
    return india | us | {name: code for code, names in FRANCE_REGIONS.items() for name in names.split(", ")}
