"""What matching knows before anything is learned. Fixed values; every table can be replaced by a caller's own."""

from __future__ import annotations

# Names by field, in order.
NAMES = {
    "carrier": ["CALIFORNIA MATERIALS, INC.", "California Materials, Inc."],
    "consignor": ["Clean Planet", "Clean Planet Hooper", "C.P.I. Hooper", "Bell Marine", "Granite Vernalis"],
    "consignee": ["Aquamarine", "Aquamarine Contractors Inc.", "A&A Concrete", "CORONE & CO", "AA Concrete"],
    "driver_name": ["Isaac Cordero", "Mike Gordon"],
    "origin": ["North Hooper", "N. Hooper St.", "W. Hooper St.", "Stockton, CA", "Vernalis, CA", "Bell Marine"],
    "destination": ["Discovery Bay", "Discovery Bay, CA", "Tracy, CA", "Palm Wood", "Palm Orwood Tract", "Cannon Landfill"],
    "driver_signature": ["Isaac Cordero", "Mike Gordon"],
}
# Misreadings by collapsed key.
ALIASES = {
    "consignor": {
        "cpihooper": "Clean Planet Hooper", "cleanplanet": "Clean Planet Hooper", "crimplanet": "Clean Planet Hooper", "crimplanethooper": "Clean Planet Hooper",
        "oceanplanet": "Clean Planet Hooper", "grandplanethooper": "Clean Planet Hooper", "bellmarine": "Bell Marine", "bellnarine": "Bell Marine",
    },
    "consignee": {
        "aguamarene": "Aquamarine", "aquamarine": "Aquamarine", "pauumeine": "Aquamarine", "pauumeinecons": "Aquamarine", "colonel9co": "CORONE & CO", "colonelco": "CORONE & CO",
        "colonelandco": "CORONE & CO", "coronel9co": "CORONE & CO", "coronelco": "CORONE & CO", "coroneandco": "CORONE & CO", "corone": "CORONE & CO",
    },
    "origin": {
        "noenhouper": "North Hooper", "vhosper": "W. Hooper St.", "whosper": "W. Hooper St.", "hosper": "W. Hooper St.", "nhesper": "N. Hooper St.", "bellmarine": "Bell Marine", "bellnarine": "Bell Marine",
    },
    "destination": {
        "concord": "Cannon Landfill", "cannon": "Cannon Landfill", "cannonlandfill": "Cannon Landfill", "canonlandfill": "Cannon Landfill", "cannonlf": "Cannon Landfill", "canonlf": "Cannon Landfill",
    },
}
# Streets by ZIP and by city.
STREETS_BY_ZIP = {"95213": ["North Hooper St", "N. Hooper St."], "95204": ["North Hooper St"], "94505": ["Orwood Rd"], "95385": ["Vernalis Rd"]}
STREETS_BY_CITY = {"stockton": ["North Hooper St", "N. Hooper St.", "N. Hooper St"], "discovery bay": ["Orwood Rd"], "vernalis": ["Vernalis Rd"], "tracy": ["W. Linne Rd", "Linne Rd"]}
# ZIPs of the region by city, all of one state.
STATE = "CA"
ZIPS_BY_CITY = {
    "Discovery Bay": ["94505"], "Antioch": ["94509", "94531"], "Brentwood": ["94513"], "Byron": ["94514"], "Livermore": ["94550", "94551"], "Oakley": ["94561"], "Pittsburg": ["94565"],
    "Stockton": ["95201", "95202", "95203", "95204", "95205", "95206", "95207", "95209", "95210", "95211", "95212", "95213", "95215", "95219", "95267"], "Acampo": ["95220"], "French Camp": ["95231"], "Lodi": ["95240", "95242"],
    "Tracy": ["95304", "95376", "95377", "95391"], "Ceres": ["95307"], "Escalon": ["95320"], "Lathrop": ["95330"], "Manteca": ["95336", "95337"], "Modesto": ["95350", "95351", "95354", "95355", "95356", "95357", "95358"],
    "Oakdale": ["95361"], "Patterson": ["95363"], "Ripon": ["95366"], "Riverbank": ["95367"], "Turlock": ["95380", "95382"], "Vernalis": ["95385"],
}
# States that an address may name.
STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split()
ZIPS = sorted((z, c, STATE) for c, zs in ZIPS_BY_CITY.items() for z in zs)
#: Rows (field, ord, name), (field, alias_key, canonical), (zip, street, ord), (city, street, ord).
NAME_ROWS = [(f, i, n) for f, ns in NAMES.items() for i, n in enumerate(ns)]
ALIAS_ROWS = [(f, k, c) for f, ks in ALIASES.items() for k, c in ks.items()]
ZIP_STREETS = [(z, s, i) for z, ss in STREETS_BY_ZIP.items() for i, s in enumerate(ss)]
CITY_STREETS = [(c, s, i) for c, ss in STREETS_BY_CITY.items() for i, s in enumerate(ss)]
