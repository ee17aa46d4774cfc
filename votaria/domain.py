"""Fixed values of the domain, as plain tables and small frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Party codes in seating order, with bloc; votes; the parties in government.
PARTIES = {"A": "vänster", "GR": "vänster", "KS": "vänster", "ÖP": "mitten", "N": "mitten", "LTH": "höger", "HV": "höger", "F": "höger"}
PARTY_NAMES = ["Allmogen", "Gröna rutan", "Kustsamlingen", "Öppna partiet", "Norrunionen", "Land, torv och hav", 'Hembygd "Vi"', "Framtidslistan"]
GOVERNMENT = ["LTH", "ÖP", "HV"]
VOTES = ["Ja", "Nej", "Avstår", "Frånvarande"]
CAST = VOTES[:3]
DECIDED = VOTES[:2]
TIERS = ["explicit", "extrapolated", "off_axis"]
IMPLIED = {"stodjer": "Nej", "avvisar": "Ja"}
AREAS = {"LbU": "Land", "EnU": "Energi", "TrU": "Trafik", "BoU": "Boende", "VdU": "Vård", "KlU": "Kultur", "ArU": "Arbete", "HaU": "Handel", "SkoU": "Skola", "RäU": "Rätt"}
OTHER_AREA = "Övrigt"


def parties(spark: SparkSession) -> DataFrame:
    """``parti, bloc, seat_order``: eight rows."""
    return spark.createDataFrame([(p, b, i) for i, (p, b) in enumerate(PARTIES.items())], "parti string, bloc string, seat_order int")


def areas(spark: SparkSession) -> DataFrame:
    """``utskott_key, policy_area``: ten rows, key in upper case."""
    return spark.createDataFrame([(k.upper(), v) for k, v in AREAS.items()], "utskott_key string, policy_area string")
