"""A small landed data set: every input file of the three analyses, by hand."""

from pathlib import Path

from areashift.plans.inputs import Paths
from areashift.schemas import (
    DEMOGRAPHICS_2010,
    DEMOGRAPHICS_2018,
    FACTS,
    HOUSING,
    POPULATION,
    current_rates,
    prior_rates,
)
from areashift.sources.writers import land_facts

# Old tract: popul, hhinc, white, hispa, black, asian.
OLD_TRACTS = {
    "17031490400": (1000.0, 40000.0, 20.0, 70.0, 5.0, 5.0),
    "17031490300": (2000.0, 50000.0, 30.0, 60.0, 5.0, 5.0),
    "17031806003": (5000.0, 70000.0, 61.3, 20.0, 10.0, 5.0),
    "17197980100": (1000.0, None, 50.0, 20.0, 20.0, 5.0),
    "17197884103": (4000.0, 60000.0, 50.0, 20.0, 20.0, 5.0),
    "17197880903": (3000.0, 80000.0, 50.0, 20.0, 20.0, 5.0),
    "17043000100": (800.0, 55000.0, 90.0, 1.0, 1.0, 1.0),
    "17089000100": (700.0, 45000.0, 10.0, 1.0, 88.0, 1.0),
    "01001020100": (600.0, 30000.0, 20.0, 5.0, 70.0, 5.0),
}
CROSSWALK = [
    ("17031490400", "17031490200", 100, 32.2),
    ("17031490300", "17031490200", 100, 67.8),
    ("17031806003", "17031806005", 45, 100),
    ("17031806003", "17031806006", 55, 100),
    ("17197980100", "17197880903", 10, 5),
    ("17197884103", "17197880903", 2, 1),
    ("17197880903", "17197880903", 96, 94),
    ("17043000100", "17043000200", 0, 0),
    ("17043000900", "17043000901", 100, 100),
    ("1001020100", "1001020100", 100, 100),
]
# New tract: current rate as text, prior rate.
NEW_TRACTS = {
    "17031490200": ("55.0", 60.0),
    "17031806005": ("80.0", 78.0),
    "17031806006": ("70.0", 74.0),
    "17197880903": ("66.0", 65.0),
    "17043000200": ("90.0", 90.0),
    "17043000901": ("x", 50.0),
    "01001020100": ("40.0", 45.0),
}
PLACES = {"1714000": ("60.7", 58.2), "1703012": ("71.0", 70.0), "1799999": (None, 50.0)}
COUNTIES = {"031": ("63.1", 66.0, 65.0), "197": ("75.2", 77.0, 74.5)}


def _facts(geography, survey, year, state, county, geoid, name, values):
    return [
        (geography, survey, year, state, county, geoid, name, variable, value, 1.0)
        for variable, value in values.items()
        if value is not None
    ]


def _demographics(vintage, popul, hhinc, white, hispa, black, asian):
    measures = {
        "popul": popul,
        "hhold": popul / 2.5,
        "hunit": popul / 2,
        "hhinc": hhinc,
        "white": white,
        "hispa": hispa,
        "black": black,
        "asian": asian,
        "povty": 12.5,
        "lmeng": 3.5,
    }
    return {variable: measures[name] for variable, name in vintage.variables.items()}


def all_facts():
    rows = []
    for year, vintage in ((2010, DEMOGRAPHICS_2010), (2018, DEMOGRAPHICS_2018)):
        for geoid, values in OLD_TRACTS.items():
            rows += _facts(
                "tract", "acs5", year, geoid[:2], geoid[2:5], geoid, f"Tract {geoid}",
                _demographics(vintage, *values),
            )
        for county, housing in (("031", 4000.0), ("197", 4100.0), ("099", 10.0)):
            name = f"County {county}"
            rows += _facts(
                "county", "acs1", year, "17", county, f"17{county}", name,
                {HOUSING: housing + year},
            )
    for geoid in PLACES:
        rows += _facts(
            "place", "acs5", 2018, "17", None, geoid, f"Place {geoid}",
            _demographics(DEMOGRAPHICS_2018, 100.0, 1000.0, 60.0, 20.0, 10.0, 5.0),
        )
    for geoid, popul in (("11111", 9e6), ("22222", 5e6), ("33333", 1e5)):
        rows += _facts("metro", "acs5", 2018, None, None, geoid, f"M {geoid}", {POPULATION: popul})
    return rows


def _codes(geography, code):
    return {
        "tract": (code[:2], code[2:5], code[5:]),
        "place": (code[:2], code[2:]),
        "county": (code[:2], code[2:]),
    }[geography]


def _write_rates(spark, root, geography, prefix, units):
    current = [
        (name, prefix + code, *_codes(geography, code), now, "30.0", "2020-08-19")
        for code, name, now, _ in units
    ]
    prior = [
        (name, prefix + code, *_codes(geography, code), before)
        for code, name, _, before in units
    ]
    spark.createDataFrame(current, current_rates(geography)).write.parquet(
        f"{root}/current/{geography}"
    )
    spark.createDataFrame(prior, prior_rates(geography)).write.parquet(
        f"{root}/prior/{geography}"
    )


def land(spark, root: Path) -> Paths:
    land_facts(spark.createDataFrame(all_facts(), FACTS), f"{root}/facts")
    _write_rates(
        spark, root, "tract", "1400000US",
        [(c, f"Tract {c}", now, before) for c, (now, before) in NEW_TRACTS.items()],
    )
    _write_rates(
        spark, root, "place", "1600000US",
        [(c, f"Place {c}", now, before) for c, (now, before) in PLACES.items()],
    )
    _write_rates(
        spark, root, "county", "0500000US",
        [(f"17{c}", f"County {c}", now, before) for c, (now, before, _) in COUNTIES.items()],
    )

    # Column order differs from the schema, and a column more is present.
    lines = ["OID,STATEFP10,COUNTYFP10,GEOID10,GEOID20,HU10PCT_T10,HU10PCT_T20,HUCURPCT_T10,HUCURPCT_T20"]
    for i, (old, new, of_old, of_new) in enumerate(CROSSWALK):
        padded = old.zfill(11)
        state, county = str(int(padded[:2])), str(int(padded[2:5]))
        lines.append(f"{i},{state},{county},{old},{new},{of_old},{of_new},{of_old},{of_new}")
    (root / "crosswalk.txt").write_text("\n".join(lines) + "\n")

    (root / "groups.csv").write_text(
        "MSA_GEOID,MSA,County_GEOID,County\n"
        '11111,"Lakes, IL (Metropolitan Statistical Area)",17031,"Cook County, IL"\n'
        '11111,"Lakes, IL (Metropolitan Statistical Area)",17197,Will\n'
        "11111,Focus Region,17031,Cook\n"
        "22222,South (Metropolitan Statistical Area),1001,Autauga\n"
        "33333,Small (Metropolitan Statistical Area),17043,NA\n"
    )
    (root / "places.csv").write_text("GEO_ID,Place\n1600000US1714000,A\n1600000US1799999,B\n")
    snapshot = "GEO_ID,NAME,CRRALL\n0100000US,US,63.0\n1400000US17031490200,T,10\n"
    snapshot += "".join(f"0500000US17{c},C,{day}\n" for c, (_, _, day) in COUNTIES.items())
    snapshot += "0500000US01001,A,1.0\n"
    (root / "snapshot.csv").write_bytes(b"\xef\xbb\xbf" + snapshot.encode())

    return Paths(
        facts=f"{root}/facts",
        current_rates=f"{root}/current",
        prior_rates=f"{root}/prior",
        crosswalk=f"{root}/crosswalk.txt",
        group_lookup=f"{root}/groups.csv",
        place_list=f"{root}/places.csv",
        snapshot=f"{root}/snapshot.csv",
    )
