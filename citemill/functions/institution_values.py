"""Fixed values of institution resolution: words, names and aliases. Order matters in the tables."""

COMPANY = "biologics biopharma biopharmaceuticals biosciences biotech biotherapeutics diagnostics genomics medicines pharmaceuticals pharma therapeutics".split()
ANCHORS = "clinic college foundation hospital institute institutes school system university".split()
ORG_SUFFIXES = "inc incorporated ltd llc corp corporation gmbh sa ag bv plc medicines pharmaceuticals therapeutics biotherapeutics biologics biosciences".split()
UNITS = "center centre department departments division faculty lab laboratory program section unit".split()
UNIT_PREFIXES = "department departments division center centre laboratory lab program section unit faculty".split()
MARKERS = "center centre clinic college foundation hospital institute institutes laboratory school system university".split()
BLOCKED_LABELS = "project projects program programs network networks consortium consortia initiative initiatives".split()
GEO = "country state city county province usa us united states massachusetts boston".split()
STATE_CODES = (
    "al ak az ar ca co ct dc de fl ga hi ia id il in ks ky la ma md me mi mn mo ms mt nc nd ne nh nj nm nv "
    "ny oh ok or pa ri sc sd tn tx ut va vt wa wi wv wy"
).split()
STATES = (
    "Alabama, Alaska, Arizona, Arkansas, California, Colorado, Connecticut, Delaware, Florida, Georgia, Hawaii, Idaho, Illinois, Indiana, Iowa, Kansas, "
    "Kentucky, Louisiana, Maine, Maryland, Massachusetts, Michigan, Minnesota, Mississippi, Missouri, Montana, Nebraska, Nevada, New Hampshire, New Jersey, "
    "New Mexico, New York, North Carolina, North Dakota, Ohio, Oklahoma, Oregon, Pennsylvania, Rhode Island, South Carolina, South Dakota, Tennessee, Texas, "
    "Utah, Vermont, Virginia, Washington, West Virginia, Wisconsin, Wyoming"
).split(", ")
COUNTRIES = (
    "Afghanistan, Albania, Algeria, Andorra, Angola, Argentina, Armenia, Australia, Austria, Azerbaijan, Bahrain, Bangladesh, Belarus, Belgium, Belize, Benin, "
    "Bhutan, Bolivia, Bosnia and Herzegovina, Botswana, Brazil, Brunei, Bulgaria, Burkina Faso, Burundi, Cambodia, Cameroon, Canada, Cape Verde, "
    "Central African Republic, Chad, Chile, China, Colombia, Comoros, Congo, Costa Rica, Croatia, Cuba, Cyprus, Czech Republic, Czechia, Denmark, Djibouti, "
    "Dominica, Dominican Republic, Ecuador, Egypt, El Salvador, Equatorial Guinea, Eritrea, Estonia, Eswatini, Ethiopia, Fiji, Finland, France, Gabon, Gambia, "
    "Georgia, Germany, Ghana, Greece, Guatemala, Guinea, Guinea-Bissau, Guyana, Haiti, Honduras, Hungary, Iceland, India, Indonesia, Iran, Iraq, Ireland, "
    "Israel, Italy, Jamaica, Japan, Jordan, Kazakhstan, Kenya, Kuwait, Kyrgyzstan, Laos, Latvia, Lebanon, Lesotho, Liberia, Libya, Lithuania, Luxembourg, "
    "Madagascar, Malawi, Malaysia, Mali, Malta, Mauritania, Mauritius, Mexico, Moldova, Monaco, Mongolia, Montenegro, Morocco, Mozambique, Myanmar, Namibia, "
    "Nepal, Netherlands, New Zealand, Nicaragua, Niger, Nigeria, North Macedonia, Norway, Oman, Pakistan, Panama, Papua New Guinea, Paraguay, Peru, "
    "Philippines, Poland, Portugal, Qatar, Romania, Russia, Rwanda, Saudi Arabia, Senegal, Serbia, Sierra Leone, Singapore, Slovakia, Slovenia, Somalia, "
    "South Africa, South Korea, South Sudan, Spain, Sri Lanka, Sudan, Sweden, Switzerland, Syria, Taiwan, Tanzania, Thailand, Tunisia, Turkey, Uganda, Ukraine, "
    "United Arab Emirates, United Kingdom, Uruguay, Uzbekistan, Venezuela, Vietnam, Yemen, Zambia, Zimbabwe"
).split(", ")
COUNTRY_ALIASES = {
    "uk": "United Kingdom", "u k": "United Kingdom", "great britain": "United Kingdom", "england": "United Kingdom", "scotland": "United Kingdom",
    "wales": "United Kingdom", "northern ireland": "United Kingdom", "uae": "United Arab Emirates", "u a e": "United Arab Emirates",
    "russian federation": "Russia", "republic of korea": "South Korea", "korea republic of": "South Korea", "viet nam": "Vietnam", "turkiye": "Turkey",
    "cote d'ivoire": "Cote d'Ivoire", "cote divoire": "Cote d'Ivoire", "ivory coast": "Cote d'Ivoire", "cabo verde": "Cape Verde",
}
US_KEYS = ("us", "usa", "u s", "u s a", "united states", "united states of america", "america")

SURE_SUFFIXES = (
    "school of medicine", "medical school", "medical center", "health center", "health science center", "health sciences center", "health sciences",
    "school of public health", "college of medicine", "school of pharmacy", "college of pharmacy", "school of dentistry", "school of nursing",
)
KEPT_SUFFIXES = {"medical center": "Medical Center", "medical school": "Medical School", "school of medicine": "School of Medicine"}
STATE_CAMPUSES = {
    "alabama": {"huntsville": "Huntsville"}, "hawaii": {"manoa": "Manoa"}, "louisiana": {"lafayette": "Lafayette", "monroe": "Monroe"},
    "missouri": {"kansas city": "Kansas City", "st louis": "St. Louis"}, "nebraska": {"lincoln": "Lincoln", "omaha": "Omaha"},
    "nevada": {"las vegas": "Las Vegas", "reno": "Reno"}, "tennessee": {"southern": "Southern"},
}
LITERALS = (
    "Alabama State University", "Albany College of Pharmacy and Health Sciences", "Albany Medical Center", "Arkansas Children's Research Institute",
    "Augusta University School of Medicine", "Florida Atlantic University",
)
LITERAL_SUFFIXES = (
    "College of Pharmacy and Health Sciences", "University School of Medicine", "School of Public Health", "Medicines", "Pharmaceuticals", "Therapeutics",
    "Biotherapeutics", "Biologics", "Biosciences", "Incorporated", "Corporation", "State University", "Research Institute", "Medical Center", "College",
    "University", "Ltd", "LLC", "Inc", "Corp", "GmbH", "PLC", "BV", "AG", "SA",
)
NOT_ALONE = ("university", "college", "state university", "medical center", "research institute", "school of public health")
#: System: phrases, tokens, campus aliases in order.
SYSTEMS = {
    "University of California": (
        ("university of california",),
        "uc ucb ucberkeley ucd ucdavis uci ucirvine ucla ucm ucmerced ucr ucriverside ucsb ucsantabarbara ucsc ucsantacruz ucsd ucsf".split(),
        {c.lower(): c for c in ("Berkeley", "Davis", "Irvine", "Los Angeles", "Merced", "Riverside", "San Diego", "San Francisco", "Santa Barbara", "Santa Cruz")},
    ),
    "University of North Carolina": (
        ("university of north carolina", "unc system"),
        "unc uncch uncc uncg uncw ncsu ncstate".split(),
        {c.lower(): c for c in ("Chapel Hill", "Charlotte", "Greensboro", "Wilmington", "Asheville", "Pembroke", "Boone", "Cullowhee", "Greenville", "Raleigh", "Fayetteville", "Elizabeth City")} | {"winston salem": "Winston-Salem"},
    ),
    "University of Texas": (
        ("university of texas", "ut system"),
        "utaustin utarlington utdallas utep utrgv utsa uttyler utpb utpermianbasin utmb uthealth uthouston utsouthwestern utmda mdanderson".split(),
        {c.lower(): c for c in ("Austin", "Arlington", "Dallas", "El Paso", "Rio Grande Valley", "San Antonio", "Tyler", "Permian Basin", "Galveston", "Houston")} | {"md anderson": "Houston", "southwestern": "Dallas"},
    ),
    "University of Colorado": (
        ("university of colorado", "cu system"),
        "cuboulder cudenver uccs cuanschutz".split(),
        {"boulder": "Boulder", "denver": "Denver", "colorado springs": "Colorado Springs", "anschutz": "Anschutz Medical Campus"},
    ),
    "University of Massachusetts": (
        ("university of massachusetts", "umass system"),
        "umass umassamherst umassboston umassdartmouth umasslowell umasschan".split(),
        {"amherst": "Amherst", "boston": "Boston", "dartmouth": "Dartmouth", "lowell": "Lowell", "worcester": "Chan Medical School", "chan": "Chan Medical School"},
    ),
    "University of Wisconsin": (
        ("university of wisconsin", "uw system"),
        "uwmadison uwmilwaukee uwgreenbay uweauclaire uwlacrosse".split(),
        {c.lower(): c for c in ("Madison", "Milwaukee", "Green Bay", "Eau Claire", "La Crosse", "Oshkosh", "Platteville", "River Falls", "Stevens Point", "Stout", "Superior", "Whitewater", "Parkside")},
    ),
    "State University of New York": (
        ("state university of new york", "suny"),
        ["suny"],
        {c.lower(): c for c in ("Albany", "Binghamton", "Buffalo", "Stony Brook", "New Paltz", "Oswego", "Geneseo", "Purchase", "Potsdam", "Plattsburgh", "Fredonia", "Cortland", "Brockport", "Oneonta")}
        | {
            "upstate": "Upstate Medical University", "downstate": "Downstate Health Sciences University", "polytechnic": "Polytechnic Institute",
            "esf": "College of Environmental Science and Forestry", "optometry": "College of Optometry", "maritime": "Maritime College",
        },
    ),
    "City University of New York": (
        ("city university of new york", "cuny"),
        ["cuny"],
        {
            "baruch": "Baruch College", "brooklyn college": "Brooklyn College", "city college": "City College", "hunter college": "Hunter College",
            "queens college": "Queens College", "lehman college": "Lehman College", "john jay": "John Jay College", "staten island": "College of Staten Island",
            "medgar evers": "Medgar Evers College", "borough of manhattan": "Borough of Manhattan Community College", "bmcc": "Borough of Manhattan Community College",
            "kingsborough": "Kingsborough Community College", "queensborough": "Queensborough Community College", "laguardia": "LaGuardia Community College",
            "graduate center": "Graduate Center", "school of law": "School of Law", "school of public health": "School of Public Health",
        },
    ),
}
#: Institutions that the lookup knows without a user's registry: kind, key, name.
SEED = (
    ("ror", "https://ror.org/04b6nzv94", "Brigham and Women's Hospital"),
    ("grid", "grid.62560.37", "Brigham and Women's Hospital"),
    ("text", "brighamandwomenshospital", "Brigham and Women's Hospital"),
    ("text", "harvardmedicalschool", "Harvard University"),
    ("text", "harvarduniversity", "Harvard University"),
    ("text", "hospitalforspecialsurgery", "Hospital for Special Surgery"),
    ("text", "yaleuniversityschoolofmedicine", "Yale University"),
    ("text", "yaleuniversity", "Yale University"),
    ("text", "arizonastateuniversitytempe", "Arizona State University-Tempe"),
    ("text", "texasaandmuniversity", "Texas A&M"),
    ("text", "texasaandm", "Texas A&M"),
)
