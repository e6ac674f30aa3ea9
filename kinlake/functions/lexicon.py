"""Word lists for names and addresses, and letters that fold to others. All are parameters' defaults."""

# Fixed values of the linkage task's normalisers: they must be these for equal results.

#: Abbreviation -> word, in names. The last lines are legal words of Indic scripts as `text.fold_scripts` writes them.
NAME_WORDS = {
    "pvt": "private", "prv": "private", "ltd": "limited", "lmtd": "limited", "corp": "corporation",
    "co": "company", "cos": "companies", "inc": "incorporated", "intl": "international",
    "mfg": "manufacturing", "mfrs": "manufacturers", "svc": "service", "svcs": "services",
    "srvcs": "services", "bros": "brothers", "assoc": "associates", "assocs": "associates",
    "natl": "national", "dept": "department", "grp": "group", "hldgs": "holdings",
    "ent": "enterprises", "entp": "enterprises", "ind": "industries", "inds": "industries",
    "mgmt": "management", "sys": "systems", "sol": "solutions", "solns": "solutions",
    "praaivett": "private", "praaibhett": "private", "praivrrrr": "private", "praa": "private",
    "limittedd": "limited", "limirrrrdd": "limited", "li": "limited", "knpnii": "company",
}

#: Words that a core name is without.
LEGAL_WORDS = (
    "private limited incorporated corporation company llc llp lp plc pllc opc sarl sas sasu eurl sa sci snc selarl gmbh ag "
    "bv nv pty pte the and dba of smt shri sri dr mr mrs ms center centre www com net org "
    "cie ets societe srl gie et fils freres developpement groupe france doing business as aka"
).split()

#: Abbreviation -> word, in addresses; 'unit' marks a part of a building.
ADDRESS_WORDS = {
    "st": "street", "str": "street", "rd": "road", "ave": "avenue", "av": "avenue", "blvd": "boulevard",
    "bd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court", "hwy": "highway", "pkwy": "parkway",
    "apt": "apartment", "fl": "floor", "flr": "floor", "bldg": "building",
    "pl": "place", "sq": "square", "cir": "circle", "trl": "trail", "ter": "terrace",
    "n": "north", "s": "south", "e": "east", "w": "west", "ne": "northeast", "nw": "northwest",
    "se": "southeast", "sw": "southwest", "opp": "opposite", "nr": "near", "ngr": "nagar",
    "mkt": "market", "rly": "railway", "stn": "station", "sec": "sector", "sect": "sector",
    "chs": "chowk", "fg": "faubourg", "rte": "route", "imm": "immeuble", "keralam": "kl",
    "bld": "boulevard", "boul": "boulevard", "chem": "chemin", "imp": "impasse", "fbg": "faubourg",
    "qu": "quai", "all": "allee", "saint": "street", "sainte": "street", "r": "rue", "ch": "chemin",
    "suite": "unit", "ste": "unit", "apartment": "unit", "unit": "unit",
}

#: Words that addresses are compared without; de and la stay, as they are codes of states.
ADDRESS_DROP = "no number h hno city na the of cedex france du des le".split()

#: State -> postal code of two letters: United States, then India.
STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de",
    "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky",
    "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo",
    "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny",
    "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "rhode island": "ri",
    "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa",
    "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy", "district of columbia": "dc",
    "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br", "chhattisgarh": "cg", "goa": "ga", "gujarat": "gj", "haryana": "hr",
    "himachal pradesh": "hp", "jharkhand": "jh", "karnataka": "ka", "kerala": "kl", "madhya pradesh": "mp", "maharashtra": "mh", "manipur": "mn",
    "meghalaya": "ml", "mizoram": "mz", "nagaland": "nl", "odisha": "od", "orissa": "od", "punjab": "pb", "rajasthan": "rj", "sikkim": "sk",
    "tamil nadu": "tn", "telangana": "tg", "tripura": "tr", "uttar pradesh": "up", "uttarakhand": "uk", "west bengal": "wb", "delhi": "dl",
    "new delhi": "dl", "jammu and kashmir": "jk", "chandigarh": "ch", "puducherry": "py", "pondicherry": "py",
}

#: Indian states in their own scripts -> code.
NATIVE_STATES = {
    "महाराष्ट्र": "mh", "दिल्ली": "dl", "पश्चिम बंगाल": "wb", "পশ্চিমবঙ্গ": "wb", "ಕರ್ನಾಟಕ": "ka", "తెలంగాణ": "tg", "ఆంధ్ర ప్రదేశ్": "ap", "தமிழ்நாடு": "tn",
    "കേരളം": "kl", "ગુજરાત": "gj", "उत्तर प्रदेश": "up", "मध्य प्रदेश": "mp", "राजस्थान": "rj", "बिहार": "br", "ਪੰਜਾਬ": "pb", "ଓଡ଼ିଶା": "od",
    "हरियाणा": "hr", "झारखंड": "jh", "छत्तीसगढ़": "cg", "उत्तराखंड": "uk", "অসম": "as", "गोवा": "ga", "हिमाचल प्रदेश": "hp",
}

#: The suffix normaliser's own lists: abbreviation -> word in names, trailing legal words, abbreviation -> word in addresses.
SUFFIX_NAME_WORDS = {
    "pvt": "private", "pv": "private", "ltd": "limited", "co": "company", "cos": "companies", "corp": "corporation", "inc": "incorporated",
    "incorp": "incorporated", "intl": "international", "int": "international", "mfg": "manufacturing", "mfrs": "manufacturers", "bros": "brothers",
    "assoc": "associates", "assocs": "associates", "ent": "enterprises", "ents": "enterprises", "entp": "enterprises", "svc": "services",
    "svcs": "services", "serv": "services", "mgmt": "management", "mgt": "management", "dept": "department", "natl": "national", "govt": "government",
    "tech": "technologies", "techs": "technologies", "sys": "systems", "sol": "solutions", "solns": "solutions", "grp": "group", "hldgs": "holdings",
    "hldg": "holding", "ind": "industries", "inds": "industries", "indus": "industries", "engg": "engineering", "eng": "engineering",
    "dist": "distributors", "distr": "distributors", "mkt": "marketing", "univ": "university", "hosp": "hospital", "ctr": "center", "centre": "center",
    "cie": "compagnie", "ste": "societe", "st": "saint",
}
LEGAL_TAIL = (
    "private limited company corporation incorporated llc llp lp plc pllc pc gmbh ag sa sas sasu sarl eurl sci snc bv nv pty pte ltda spa srl opc and compagnie et the"
).split()
SUFFIX_ADDRESS_WORDS = {
    "st": "street", "str": "street", "rd": "road", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "bd": "boulevard", "bld": "boulevard",
    "dr": "drive", "ln": "lane", "hwy": "highway", "pkwy": "parkway", "ct": "court", "pl": "place", "sq": "square", "ste": "suite", "apt": "apartment",
    "fl": "floor", "flr": "floor", "bldg": "building", "blk": "block", "sec": "sector", "sect": "sector", "ph": "phase", "nr": "near",
    "opp": "opposite", "mkt": "market", "ngr": "nagar", "clny": "colony", "extn": "extension", "ext": "extension", "n": "north", "s": "south",
    "e": "east", "w": "west", "mt": "mount", "ft": "fort", "hts": "heights", "cir": "circle", "ctr": "center", "centre": "center", "jn": "junction",
    "jct": "junction", "ch": "chemin", "imp": "impasse", "fbg": "faubourg", "rte": "route", "no": "number", "num": "number", "ofc": "office",
    "dist": "district", "distt": "district", "tq": "taluk", "tal": "taluk", "po": "postoffice",
}

#: The basic normaliser's suffixes of names, and abbreviations of addresses.
BASIC_SUFFIXES = {"pvt": "private", "ltd": "limited", "corp": "corporation", "inc": "incorporated", "llc": "limited liability company", "plc": "public limited company", "co": "company"}
BASIC_ADDRESS_WORDS = {"rd": "road", "st": "street", "ave": "avenue", "blvd": "boulevard", "fl": "floor", "ste": "suite", "no": "number", "nr": "near", "opp": "opposite", "bldg": "building"}

# End of the task's fixed values.

#: Country alias -> code.
COUNTRIES = {
    "us": "us", "usa": "us", "u s a": "us", "united states": "us", "united states of america": "us", "america": "us",
    "in": "in", "ind": "in", "india": "in", "bharat": "in", "fr": "fr", "fra": "fr", "france": "fr", "gb": "gb", "uk": "gb", "united kingdom": "gb", "great britain": "gb",
    "de": "de", "deu": "de", "germany": "de", "deutschland": "de", "es": "es", "esp": "es", "spain": "es", "espana": "es",
}

#: Latin letters with marks -> plain letters, in step; letters that fold to two are apart.
FOLD_FROM = "àáâãäåāăąçćčďéèêëēęěìíîïīłñńňòóôõöøōùúûüūůýÿžźżšśřţťğ"
FOLD_TO = "aaaaaaaaacccdeeeeeeeiiiiilnnnooooooouuuuuuyyzzzssrttg"
FOLD_PAIRS = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "đ": "d", "ð": "d"}
