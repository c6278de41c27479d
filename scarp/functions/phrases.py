"""Words of alerts in English (en) and Nepali (ne), and Column expressions that fill them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import nepali_digits, short_number, stripped_zeros

LANGUAGES = ("en", "ne")
# The phrases of alerts.
LEVEL = {
    "high": {"en": "HIGH RISK", "ne": "उच्च जोखिम"},
    "medium": {"en": "MEDIUM RISK", "ne": "मध्यम जोखिम"},
    "low": {"en": "LOW RISK", "ne": "न्यून जोखिम"},
    "unknown": {"en": "UNKNOWN", "ne": "अज्ञात"},
}
SITE_KIND = {
    "glacial_lake": {"en": "glacial lake", "ne": "हिमताल"},
    "glacier": {"en": "glacier", "ne": "हिमनदी"},
    "slope": {"en": "ice/rock slope", "ne": "हिउँ-चट्टानको भिर"},
    "barrier_lake": {"en": "landslide-dammed lake", "ne": "पहिरोले थुनिएको ताल"},
    "landslide": {"en": "landslide", "ne": "पहिरो"},
}
HAZARD = {
    "glacial_lake": {"en": "glacial lake outburst flood (GLOF)", "ne": "हिमताल विस्फोट बाढी (GLOF)"},
    "glacier": {"en": "ice avalanche and debris flood", "ne": "हिमपहिरो र लेदोसहितको बाढी"},
    "slope": {"en": "rock-ice avalanche and debris flood", "ne": "चट्टान-हिउँ पहिरो र लेदोसहितको बाढी"},
    "barrier_lake": {"en": "flood from a breaching landslide dam", "ne": "पहिरोले थुनेको ताल फुटेर आउने बाढी"},
    "landslide": {"en": "landslide and debris flow", "ne": "पहिरो र लेदो बाढी"},
}
ANY_HAZARD = {"en": "flood", "ne": "बाढी"}
REASON = {
    "lake_area_km2": {"en": "Lake area is {v} km²", "ne": "तालको क्षेत्रफल {v} वर्ग कि.मि. छ"},
    "lake_growth_recent_pct": {"en": "Lake grew {v}% in about a month", "ne": "ताल करिब एक महिनामा {v}% ले बढेको छ"},
    "lake_growth_annual_pct": {"en": "Lake is {v}% larger than a year ago", "ne": "ताल एक वर्षअघिभन्दा {v}% ठूलो भएको छ"},
    "glacier_contact_m": {"en": "Lake is {v} m from glacier ice", "ne": "ताल हिमनदीको हिउँबाट {v} मिटर मात्र टाढा छ"},
    "steep_walls_deg": {"en": "Steep slopes (up to {v}°) above the lake could send avalanches into it", "ne": "तालमाथि {v}° सम्मका ठाडा भिर छन्, जहाँबाट हिउँ वा चट्टान तालमा खस्न सक्छ"},
    "turbidity_rise": {"en": "Lake water has turned more turbid (+{v}%)", "ne": "तालको पानी धमिलो भएको छ (+{v}%)"},
    "barrier_lake": {"en": "A landslide has blocked the river and formed a lake", "ne": "पहिरोले नदी थुनेर ताल बनेको छ"},
    "velocity_ratio": {"en": "Ice/rock is moving {v}× faster than normal", "ne": "हिउँ/चट्टान सामान्यभन्दा {v} गुणा छिटो सरिरहेको छ"},
    "velocity_steep_m_day": {"en": "The surface is moving {v} m per day on steep ground", "ne": "ठाडो भिरमा सतह दैनिक {v} मिटर सरिरहेको छ"},
    "velocity_trend": {"en": "Speed increased in {v} consecutive measurements", "ne": "लगातार {v} पटकको मापनमा गति बढेको छ"},
    "new_fractures_m": {"en": "New cracks totalling about {v} m have appeared", "ne": "करिब {v} मिटर लामा नयाँ चिराहरू देखा परेका छन्"},
    "sar_change_km2": {"en": "Radar shows fresh surface disturbance over {v} km²", "ne": "राडार तस्बिरमा {v} वर्ग कि.मि. क्षेत्रमा सतहमा नयाँ हलचल देखिएको छ"},
    "source_slope_deg": {"en": "The source area is very steep ({v}°)", "ne": "स्रोत क्षेत्र निकै ठाडो छ ({v}°)"},
    "landslide_area_km2": {"en": "Active landslide area of {v} km²", "ne": "सक्रिय पहिरो क्षेत्र {v} वर्ग कि.मि."},
    "insar_ratio": {"en": "Radar interferometry shows the slope deforming {v}× faster than before", "ne": "राडार इन्टरफेरोमेट्रीले भिर पहिलेभन्दा {v} गुणा छिटो विकृत भइरहेको देखाएको छ"},
    "insar_mm_month": {"en": "Radar interferometry measures about {v} mm of movement per month", "ne": "राडार इन्टरफेरोमेट्रीले मासिक करिब {v} मिलिमिटर सराइ मापन गरेको छ"},
}
TOUCHES_ICE = {"en": "The lake is in contact with glacier ice", "ne": "ताल हिमनदीको हिउँसँग जोडिएको छ"}
#: Reasons whose value is shown without decimals, in tens, and in percent.
WHOLE = ("velocity_trend", "lake_growth_recent_pct", "lake_growth_annual_pct", "insar_mm_month", "steep_walls_deg", "source_slope_deg")
TENS, PERCENT = ("glacier_contact_m", "new_fractures_m"), ("turbidity_rise",)
ACTION = {
    "high": {
        "en": "Move away from the river banks to high ground now. Do not cross or stay near the river. Hydropower and road crews: stop riverside work and move staff to safety. Local authorities: activate sirens and evacuation.",
        "ne": "नदी किनारबाट तुरुन्तै अग्लो सुरक्षित स्थानमा जानुहोस्। नदी नतर्नुहोस् र किनारमा नबस्नुहोस्। जलविद्युत आयोजना र सडकमा खटिएका कामदारहरू नदी किनारको काम रोकेर सुरक्षित स्थानमा जानुहोस्। स्थानीय तहले साइरन बजाई उद्धार तथा स्थानान्तरण सुरु गर्नुहोस्।",
    },
    "medium": {
        "en": "Stay alert. Avoid spending time near the river, know your nearest high ground, and follow official instructions. Authorities: verify on the ground and prepare evacuation plans.",
        "ne": "सतर्क रहनुहोस्। नदी किनारमा अनावश्यक समय नबिताउनुहोस्, नजिकको अग्लो सुरक्षित स्थान पहिल्यै थाहा पाउनुहोस् र आधिकारिक निर्देशन पालना गर्नुहोस्। सम्बन्धित निकायले स्थलगत पुष्टि गरी उद्धार योजना तयार राख्नुहोस्।",
    },
    "low": {"en": "No action needed. Monitoring continues.", "ne": "तत्काल कुनै कदम आवश्यक छैन। अनुगमन जारी छ।"},
}
ALL_CLEAR = {"en": "Risk at {site} has decreased to {level}. Continue to follow local authority guidance.", "ne": "{site} को जोखिम घटेर {level} मा झरेको छ। स्थानीय प्रशासनको निर्देशन पालना गरिरहनुहोस्।"}
ARRIVAL = {"en": "A flood could reach {name} in as little as {min} minutes.", "ne": "बाढी {min} मिनेटभित्रै {name} पुग्न सक्छ।"}
AT_RISK = {"en": "At risk downstream: {list}.", "ne": "तल्लो तटीय क्षेत्रमा जोखिममा: {list}।"}
UNCONFIRMED = {"en": "Satellite signal not yet confirmed on the ground.", "ne": "यो स्याटेलाइट संकेत स्थलगत रूपमा पुष्टि भइसकेको छैन।"}
FOOTER = {"en": "Automated satellite early warning. Follow local authorities. Emergency: {hotline}.", "ne": "यो स्याटेलाइट तस्बिरमा आधारित स्वचालित पूर्वचेतावनी हो। स्थानीय प्रशासनको निर्देशन पालना गर्नुहोस्। आपतकालीन सम्पर्क: {hotline}।"}
MINUTES = {"en": "min", "ne": "मिनेट"}
UPDATED = {"en": "UPDATE – ", "ne": "अद्यावधिक – "}
TITLE = {"en": "{level}: {hazard} threat from {site}", "ne": "{level}: {site} बाट {hazard}को खतरा"}
CLEAR_TITLE = {"en": "{level}: risk reduced at {site}", "ne": "{level}: {site} को जोखिम घटेको छ"}
SEEN = {"en": "What the satellites show (as of {at} NPT):", "ne": "स्याटेलाइटले देखाएको परिवर्तन ({at} नेपाली समय):"}
TODO = {"en": "What to do: ", "ne": "के गर्ने: "}
DETAILS = {"en": "Details and map: ", "ne": "विस्तृत विवरण र नक्सा: "}
METRES = {"en": "m", "ne": "मिटर"}
SHORT = {"en": "Alert {level}: {hazard} threat from {site}.", "ne": "चेतावनी {level}: {site} बाट {hazard}को खतरा।"}
SHORT_ARRIVAL = {"en": "Could reach {name} in ~{min} min.", "ne": "~{min} मिनेटमा {name} पुग्न सक्छ।"}
SHORT_ACTION = {"high": {"en": "Move away from the river to high ground.", "ne": "नदी किनारबाट अग्लो ठाउँमा जानुहोस्।"}, "other": {"en": "Stay alert, avoid the riverbank.", "ne": "सतर्क रहनुहोस्, नदी किनार नजानुहोस्।"}}
SHORT_CALL = {"en": "Emergency {hotline}", "ne": "आपतकालीन {hotline}"}
STOP = {"en": ".", "ne": "।"}
#: Most characters of a short message (two segments, four in Devanagari), and of a title.
SHORT_MOST, TITLE_MOST = {"en": 306, "ne": 268}, 120
# End of the fixed values.


def phrase(table: dict, key: Column, language: str, default: Column | str | None = None) -> Column:
    """The phrase of a key in a table."""
    found = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v[language])])[key]
    return found if default is None else F.coalesce(found, F.lit(default) if isinstance(default, str) else default)


def filled(text: str | Column, **values: Column) -> Column:
    """A phrase with its blanks filled."""
    out = F.lit(text) if isinstance(text, str) else text
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), value)
    return out


def number(v: Column, language: str, decimals: int | None = None) -> Column:
    """A number as people write it, in the digits of the language."""
    text = short_number(v) if decimals is None else stripped_zeros(F.format_string(f"%.{decimals}f", v))
    return nepali_digits(text) if language == "ne" else text


def reason_text(code: Column, value: Column, language: str) -> Column:
    """Why a site is at risk, in words; the code itself where there are none."""
    tens = F.round(value / 10) * 10
    shown = F.when(code.isin(*WHOLE), number(value, language, 0)).when(code.isin(*TENS), number(tens, language, 0)).when(code.isin(*PERCENT), number(value * 100, language, 0)).otherwise(number(value, language))
    close = (code == "glacier_contact_m") & (value < 30)
    return F.when(close, TOUCHES_ICE[language]).otherwise(F.coalesce(filled(phrase(REASON, code, language), v=shown), code))
