"""Rule tables of the take-off engine: fixed values, in their own order, which gives precedence.

Operators take such tables as parameters; these are the defaults.
"""

from __future__ import annotations

#: Fixed values.  Item type, output unit, waste factor, keywords.
ESTIMATION = (
    ("flooring", "sq_ft", 1.1, ("floor", "tile", "carpet", "lvt", "vct", "vinyl", "hardwood", "laminate")),
    ("drywall", "sheets", 1.12, ("drywall", "gypsum", "gwb", "gypboard", "sheetrock", "wallboard")),
    ("paint", "gallons", None, ("paint", "primer", "finish coat", "epoxy")),
    ("wall_framing", "studs", 1.1, ("wall", "partition", "stud", "framing", "metal stud", "wood stud")),
    ("concrete_slab", "cy", None, ("concrete", "slab", "footing", "foundation", "slab-on-grade")),
    ("ceiling_grid", "sq_ft", 1.08, ("ceiling", "acoustic", "act", "lay-in", "ceiling tile", "t-bar")),
    ("doors", "ea", None, ("door", "swinging door", "double door")),
    ("windows", "ea", None, ("window", "glazing")),
    ("insulation", "sq_ft", 1.05, ("insulation", "batt", "rigid", "spray foam", "r-value")),
    ("fire_extinguisher", "ea", None, ("fire extinguisher", "extinguisher")),
    ("electrical_fixture", "ea", None, ("light fixture", "led", "exit sign", "receptacle", "switch", "panel")),
    ("storm_pipe", "lf", 1.05, ("pvc", "hdpe", "rcp", "storm pipe", "culvert", "sch 40", "storm sewer")),
    ("trench_drain", "lf", 1.05, ("trench drain", "channel drain", "slot drain", "linear drain")),
    ("catch_basin", "ea", None, ("catch basin", "bb ci", "drop inlet", "curb inlet", "storm inlet")),
    ("manhole", "ea", None, ("manhole", "mh", "access structure")),
    ("headwall", "ea", None, ("headwall", "flared end", "end section", "fes", "wingwall")),
    ("bollard", "ea", None, ("bollard", "pipe bollard")),
    ("guard_rail", "lf", 1.03, ("guard rail", "guardrail", "barrier rail", "w-beam")),
    ("hand_rail", "lf", 1.05, ("hand rail", "handrail", "stair rail")),
    ("striping", "lf", None, ("striping", "stripe", "pavement marking", "lane marking")),
    ("concrete_pavement", "sq_ft", 1.03, ("concrete pavement", "pcc", "flatwork", "sidewalk")),
    ("asphalt", "sq_ft", 1.03, ("asphalt", "hma", "blacktop")),
    ("tilt_up_wall", "sq_ft", None, ("tilt up", "tilt-up", "tiltup", "precast panel")),
    ("exposed_structure", "sq_ft", None, ("exposed structure", "exposed concrete", "exposed steel")),
    ("exterior_soffit", "sq_ft", None, ("soffit", "exterior soffit", "canopy soffit")),
    ("sealed_concrete", "sq_ft", 1.0, ("sealed concrete", "polished concrete", "concrete floor", "slab on grade", "sog")),
    ("cmu_wall", "sq_ft", 1.0, ("cmu wall", "cmu", "masonry", "block wall", "concrete masonry")),
    ("internal_tilt_up_wall", "sq_ft", 1.0, ("internal tilt", "interior tilt", "interior concrete wall", "internal tilt up", "int tilt", "tilt up wall")),
    ("columns", "ea", None, ("columns", "column", "structural column", "steel column", "concrete column")),
    ("stairs", "ea", None, ("stair", "stairway", "staircase")),
    ("ladder", "ea", None, ("ladder", "roof ladder", "wall ladder")),
    ("lift", "ea", None, ("lift", "material lift", "personnel lift", "elevator")),
    ("mobilization", "ea", None, ("mobilization", "mobilisation", "mobilize")),
    ("canopy", "sq_ft", 1.0, ("canopy", "metal canopy", "entrance canopy", "shade canopy")),
    ("eifs", "sq_ft", 1.05, ("eifs", "exterior insulation", "dryvit", "synthetic stucco")),
    ("cmu_paint", "sq_ft", 1.0, ("cmu paint", "block paint", "masonry paint", "epoxy block")),
    ("gas_pipe", "lf", 1.05, ("gas pipe", "gas piping", "black steel pipe", "csst", "gas line")),
    ("lintel", "lf", 1.05, ("lintel", "steel lintel", "angle lintel", "l-4", "lintel run")),
    ("duct_lf", "lf", 1.1, ("duct lf", "ductwork", "rectangular duct", "round duct", "spiral duct", "flex duct")),
    ("conduit_lf", "lf", 1.1, ("conduit", "emt", "pvc conduit", "rigid conduit", "wireway", "cable tray", "raceway")),
)

#: Fixed values.  Pattern sought in the lower-cased description, item name, unit.
ITEM_NAMES = (
    (r"bollard", "Bollards", "EA"),
    (r"catch basin|bb ci|drop inlet|curb inlet|storm inlet", "Catch Basins", "EA"),
    (r"manhole|\bmh\b|access structure", "Manholes", "EA"),
    (r"headwall|flared end|end section|\bfes\b|wingwall", "Headwall", "EA"),
    (r"trench drain|channel drain|slot drain|linear drain", "Trench Drain", "LF"),
    (r"gas.*pip|gas\s*pipe|black\s*steel.*pip|csst.*pip|gas\s*line", "Gas Piping", "LF"),
    (r"fire.*hydrant|\bfh\b", "Fire Hydrants", "EA"),
    (r"area.*drain|floor.*drain|cleanout", "Area Drain / Cleanout", "EA"),
    (r"\bconduit\b|\bemt\b|wireway|cable.*tray|raceway\b", "Conduit LF", "LF"),
    (r"duct.*lf|ductwork|\bduct\b(?!.*liner)", "Duct LF", "LF"),
    (r"sanitary.*pipe|sanitary.*sewer|\bss\s*pipe\b", "Sanitary Pipe", "LF"),
    (r"pvc.*pipe|pvc.*sch|pvc.*sewer|\bhdpe\b|\brcp\b|\bdip\b|storm pipe|storm sewer|culvert|sanitary sewer", "Storm Pipe", "LF"),
    (r"water.*main|water.*line|domestic.*water", "Water Main", "LF"),
    (r"guard.*rail|guardrail|barrier.*rail|w.?beam", "Guard Rail", "LF"),
    (r"hand.*rail|handrail|stair.*rail|pipe.*rail", "Hand Rail", "LF"),
    (r"strip|pavement.*mark|lane.*mark", "Striping", "LF"),
    (r"curb.*gutter|curb.*and.*gutter|\bcurb\b", "Curb & Gutter", "LF"),
    (r"\basphalt\b|\bhma\b|blacktop", "Asphalt", "SF"),
    (r"concrete.*pavement|\bpcc\b|\bflatwork\b|concrete.*drive|concrete.*walk|concrete.*sidewalk", "Concrete Pavement", "SF"),
    (r"detention|retention.*pond|bioswale", "Stormwater Basin", "EA"),
    (r"\bfence\b|chain.*link|ornamental.*fence", "Fence", "LF"),
    (r"grading|cut.*fill|mass.*grade", "Grading", "CY"),
    (r"dumpster.*enclos", "Dumpster Enclosure", "EA"),
    (r"column.*h.*\d+", "Columns", "EA"),
    (r"\bcolumn\b(?!.*h.*\d)", "Columns", "EA"),
    (r"sealed.*concrete|polished.*concrete|slab.on.grade|\bsog\b|concrete.*floor", "Sealed Concrete", "SF"),
    (r"exposed.*struct|exposed.*deck|open.*web.*joist|bar.*joist", "Exposed Structure", "SF"),
    (r"exterior.*soffit|canopy.*soffit", "Exterior Soffit", "SF"),
    (r"internal.*tilt|interior.*tilt|int.*tilt.*up", "Interior Tilt Up Walls", "SF"),
    (r"tilt.*up.*wall|tiltup.*wall|precast.*panel|ext.*tilt", "Exterior Tilt Up Wall", "SF"),
    (r"cmu.*paint|paint.*cmu|block.*paint|paint.*block|masonry.*paint|paint.*masonry|epoxy.*block", "CMU Paint", "SF"),
    (r"\bcmu\b|masonry.*wall|block.*wall|concrete.*masonry", "CMU Wall", "SF"),
    (r"\blintels?\b|steel.*lintel|angle.*lintel", "Lintels", "LF"),
    (r"stair", "Stairs", "EA"),
    (r"\bladder\b", "Ladder", "EA"),
    (r"\blift\b|elevator", "Lift", "EA"),
    (r"mobiliz", "Mobilization", "EA"),
    (r"flooring|floor tile|\blvt\b|\bvct\b|\bcarpet\b|luxury.*vinyl|ceramic.*tile|porcelain.*tile", "Flooring", "SF"),
    (r"suspended.*ceil|gyp.*ceil|acoustical.*ceil.*grid", "Drywall Ceiling", "SF"),
    (r"ceiling.*tile|\bact\b|t.bar.*ceil|acoustic.*ceil|lay.in.*ceil", "Ceiling Grid", "SF"),
    (r"drywall|\bgwb\b|gypsum.*board|sheetrock|wallboard", "Drywall", "sheets"),
    (r"\bpaint\b|primer|finish.*coat|epoxy.*floor", "Paint", "gallons"),
    (r"\beifs\b|exterior.*insulation|dryvit|synthetic.*stucco", "EIFS", "SF"),
    (r"\bcanopy\b|metal.*canopy|entrance.*canopy|shade.*canopy", "Canopy", "SF"),
    (r"insulation|\bbatt\b|rigid.*insul|spray.*foam|r-\d+", "Insulation", "SF"),
    (r"dock.*door|overhead.*door|coiling.*door", "Dock Doors", "EA"),
    (r"dock.*leveler|dock.*seal|dock.*bumper", "Dock Leveler", "EA"),
    (r"hollow.?metal.*frame|frame.*hollow.?metal|frame.*\bhm\b|\bhm\b.*frame", "Frame-HM", "EA"),
    (r"door.*hollow.?metal|hollow.?metal.*door|hm.*door(?!.*frame)|door.*\bhm\b(?!.*frame)", "Doors-HM", "EA"),
    (r"door.*\bwood\b|\bwood\b.*door|\bwd\b.*door|door.*\bwd\b", "Doors-WD", "EA"),
    (r"door.*alum|alum.*door|\bal\b.*door|door.*\bal\b", "Doors-AL", "EA"),
    (r"glass.*door|aluminum.*storefront.*door", "Doors-GL", "EA"),
    (r"door(?!.*frame)", "Doors", "EA"),
    (r"storefront|curtain.*wall|window.*wall", "Storefront/Curtain Wall", "SF"),
    (r"window|glazing|storefront.*glass", "Windows", "EA"),
    (r"gauge.*metal|metal.*gauge", "Gauge Metal", "EA"),
    (r"interior.*concrete.*wall", "Interior Concrete Walls", "SF"),
    (r"sprinkler.*head|fire.*sprinkler|pendent", "Sprinkler Heads", "EA"),
    (r"smoke.*detector|fire.*alarm|horn.*strobe", "Fire Alarm", "EA"),
    (r"\bvav\b|variable.*air.*volume", "VAV Boxes", "EA"),
    (r"unit.*heater|cabinet.*heater", "Unit Heater", "EA"),
    (r"refrigerant.*line|ref.*line|line.*set", "Refrigerant Piping", "LF"),
    (r"thermostat|t-stat", "Thermostat", "EA"),
    (r"panel|mcc\b|switchboard|distribution.*board", "Electrical Panels", "EA"),
    (r"light.*fix|fixture.*light|\bled\b|luminaire", "Lighting Fixtures", "EA"),
    (r"receptacle|outlet\b", "Receptacles", "EA"),
    (r"exit sign", "Exit Signs", "EA"),
    (r"fan coil|\bfcu\b", "Fan Coil Units", "EA"),
    (r"air handler|\bahu\b", "Air Handling Units", "EA"),
    (r"\brtu\b|rooftop.*unit|packaged.*unit", "RTU", "EA"),
    (r"exhaust fan", "Exhaust Fans", "EA"),
)

#: Fixed values.  Pattern sought in a room's notes, item type.
MATERIAL_NOTES = (
    (r"sealed\s*concrete|polished\s*concrete|sog\b|slab[- ]on[- ]grade", "sealed_concrete"),
    (r"\bvct\b|lvt\b|lvp\b|\bcarpet\b|\bhardwood\b|\blaminate\b|vinyl\s*floor|floor\s*tile|ceramic\s*tile|porcelain\s*tile", "flooring"),
    (r"acoustic\s*tile|ceiling\s*tile|ceiling\s*grid|\bact\b|lay.?in\s*ceil|t.?bar\s*ceil", "ceiling_grid"),
    (r"exposed\s*structure|exposed\s*deck|open\s*web\s*joist|bar\s*joist", "exposed_structure"),
    (r"tilt[- ]?up\s*panel?|precast\s*panel", "tilt_up_wall"),
    (r"\bcmu\b|block\s*wall|concrete\s*masonry\s*unit", "cmu_wall"),
    (r"\beifs\b|exterior\s*insulation|dryvit|synthetic\s*stucco", "eifs"),
    (r"\bcanopy\b|metal\s*canopy|entrance\s*canopy", "canopy"),
    (r"cmu\s*paint|block\s*paint|masonry\s*paint|epoxy\s*block", "cmu_paint"),
)

#: Fixed values.  Project type, default floor, ceiling and wall items, items never assumed.
PROFILES = {
    "industrial": (("sealed_concrete",), ("exposed_structure",), (), ("flooring", "ceiling_grid", "drywall")),
    "retail": (("flooring",), ("ceiling_grid",), ("paint", "drywall"), ("sealed_concrete",)),
    "office": (("flooring",), ("ceiling_grid",), ("paint", "drywall"), ("sealed_concrete", "tilt_up_wall")),
    "civil": ((), (), (), ("flooring", "ceiling_grid", "drywall")),
    "residential": (("flooring",), (), ("paint", "drywall", "insulation"), ("exposed_structure", "tilt_up_wall")),
    "institutional": (("flooring",), ("ceiling_grid",), ("paint", "drywall"), ("sealed_concrete",)),
    "mixed_use": (("flooring",), (), ("paint", "drywall"), ()),
    "auto": ((), (), (), ()),
}

#: Fixed values.  Project type, patterns that score one for it on each page.
PROJECT_KEYWORDS = {
    "industrial": (r"warehouse", r"distribution", r"industrial", r"manufacturing", r"tilt-up", r"tilt up", r"sealed concrete", r"dock door"),
    "retail": (r"retail", r"store", r"showroom", r"merchandise", r"sales floor", r"storefront", r"shopping"),
    "office": (r"office", r"tenant improvement", r"\bti\b", r"corporate", r"suites", r"open plan"),
    "civil": (r"site plan", r"grading", r"utility plan", r"civil", r"storm sewer", r"paving plan", r"grading plan"),
    "residential": (r"residence", r"dwelling", r"single family", r"unit plan", r"townhouse", r"apartment"),
    "institutional": (r"school", r"hospital", r"clinic", r"government", r"civic", r"university", r"library"),
}

INDUSTRIAL_ROOM = r"sealed\s*concrete|tilt[- ]?up|warehouse|distribution|manufacturing"
INDUSTRIAL_ROW = r"sealed\s*concrete|tilt[- ]?up|bollard|mobilization|warehouse|distribution|dock\s*door|cmu\s*wall|exposed\s*structure"

#: Fixed values.  Pipe-run item type, pattern; else storm_pipe.
PIPE_TYPES = (
    ("gas_pipe", r"gas\b|gas\s*pip|black\s*steel|csst|yellow\s*pe|gas\s*line"),
    ("duct_lf", r"duct\b|ductwork|rectangular\s*duct|spiral\s*duct|flex\s*duct|sheet\s*metal\s*duct"),
    ("conduit_lf", r"\bconduit\b|emt\b|wireway|cable\s*tray|raceway\b"),
    ("guard_rail", r"guard\s*rail|guardrail|barrier\s*rail|w.?beam"),
    ("hand_rail", r"hand\s*rail|handrail|stair\s*rail|pipe\s*rail"),
    ("striping", r"\bstrip|pavement\s*mark|lane\s*mark"),
    ("trench_drain", r"trench.*drain|channel.*drain|slot.*drain|linear.*drain"),
)

#: Fixed values.  Substrings and units that mark a measurement as no quantity.
NOISE = (
    "scale", "= 1'", "= 1 '", "= 1ft", "reference", "n.t.s.", "nts", "not to scale", "design conditions",
    "temperature", "dry bulb", "wet bulb", "design dry", "design wet",
)
TEMPERATURE_UNITS = ("f", "°f", "c", "°c", "degree", "deg")
#: Fixed values.  Item types that a detail sheet's measurements never count.
DETAIL_ONLY = ("bollard", "stairs", "columns", "ladder", "lift")

#: Fixed values.  Column names that a schedule row may use, first usable one wins.
SCHEDULE_COLUMNS = {
    "description": ("DESCRIPTION", "Description", "description", "NAME", "TYPE", "ITEM"),
    "quantity": ("QUANTITY", "QTY", "Qty", "COUNT", "Count", "AMOUNT", "Amount"),
    "mark": ("MARK", "TYPE", "FIXTURE TYPE", "CKT", "NO", "ID"),
    "unit": ("UNIT", "Unit", "UOM", "uom", "U/M"),
}
NON_QUANTITIES = ("multiple", "varies", "tbd", "n/a", "na", "-", "--", "")
RAW_COLUMNS = ("category", "sheet", "sheet_type", "page_id", "description", "value", "unit", "location_on_sheet", "source_text")
RAW_ROW_KEYS = {
    "description": ("DESCRIPTION", "Description", "description", "NAME", "Name", "TYPE", "Type", "ITEM", "Item", "ROOM", "Room"),
    "value": ("QTY", "Qty", "quantity", "COUNT", "Count", "KVA", "AMPS", "CFM", "BKR", "SIZE"),
    "mark": ("CKT", "MARK", "NO", "ID", "TAG", "REF"),
}
# Sheets that carry a drawing scale (fixed values).
SCALE_SHEET_TYPES = ("floor_plan", "civil_site", "roof_plan")
SCALE_NAME_MARKERS = ("FLOOR PLAN", "ROOF PLAN", "SITE PLAN", "CIVIL", "LAYOUT PLAN", "PLOT PLAN", "MASTER PLAN")
# Schedules that state quantities, and those that are dropped beside one (fixed values).
TAKEOFF_PURPOSES = ("takeoff_legend", "takeoff_schedule")
SECONDARY_PURPOSES = ("specification_reference", "general_notes")
# Legend words that overrule assumed rooms, room words that are overruled, and those that never are (fixed values).
SLAB_WORDS = ("sealed", "exposed", "tilt", "cmu")
OVERRULED_ROOMS = r"warehouse|distribution|industrial"
KEPT_ROOMS = r"flooring|vct|carpet"
# Fractions of an inch as they read once their slash is lost (fixed values).
COLLAPSED_FRACTIONS = {"132": 1 / 32, "116": 1 / 16, "332": 3 / 32, "18": 1 / 8, "316": 3 / 16, "14": 1 / 4, "38": 3 / 8, "12": 1 / 2, "34": 3 / 4, "32": 3 / 32, "16": 3 / 16}
FLOOR_ROOF_WORDS = ("floor", "slab", "sealed", "concrete", "flooring", "roof", "deck", "decking", "exposed", "structure", "ceiling", "joist", "membrane", "tpo", "underlayment", "topping")
# Words that make a manifest entry a wall, or a floor or roof plane (fixed values).
WALL_WORDS = ("wall", "walls", "cmu", "masonry", "tilt", "partition", "panel", "panels", "parapet", "veneer", "stud", "framing")
REFERENCE_PURPOSES = ("specification_reference", "general_notes", "finish_schedule", "room_schedule")

#: Fixed values.  Unit, least and greatest credible quantity.
SANITY_BOUNDS = {"ea": (1, 5000), "sf": (1, 500000), "lf": (1, 50000), "cy": (1, 10000), "ton": (1, 5000), "gal": (1, 100000)}
#: Fixed values.  Area types of which a schedule's row replaces a room's.
AREA_TYPES = ("sealed_concrete", "exposed_structure", "internal_tilt_up_wall", "tilt_up_wall", "cmu_wall", "flooring", "ceiling_grid")
#: Fixed values.  Civil structure types.
CIVIL_TYPES = {"catch_basin": "catch_basin", "junction_box": "catch_basin", "cleanout": "catch_basin", "manhole": "manhole", "headwall": "headwall"}
#: Fixed values.  Unit renames; quantities keep their number.
UNIT_NAMES = {
    "sf": "sq_ft", "square feet": "sq_ft", "sq ft": "sq_ft", "sq.ft": "sq_ft", "sq_ft": "sq_ft", "lf": "lf", "linear feet": "lf",
    "ft": "ft", "feet": "ft", "in": "in", "inches": "in", '"': "in", "cy": "cy", "cubic yards": "cy", "ea": "ea", "each": "ea",
    "ga": "gallons", "gal": "gallons",
}
#: Fixed values.  Words of no weight in an item's name.
STOP_WORDS = ("a", "alt", "an", "and", "assembly", "at", "ea", "for", "in", "of", "on", "system", "the", "to", "total", "typ")
#: Fixed values.  Words that the benchmark's matching leaves out.
BENCHMARK_STOP_WORDS = ("the", "a", "an", "of", "and", "to", "for", "in", "on", "alt", "h")
#: Fixed values.  What a unit measures, else a count.
UNIT_MEASURES = {
    "EA": "count", "EACH": "count", "SF": "area", "SQFT": "area", "SQ_FT": "area", "LF": "length", "FT": "length", "CY": "volume",
    "CF": "volume", "GAL": "volume", "GALLONS": "volume",
}
CONFIDENCES = ("low", "medium", "high")
#: Similarity from which a name resolves to a manifest entry.
RESOLVE_CUTOFF = 0.62

#: Fixed values.  Passes of each sheet type.
PASS_MATRIX = {
    "floor_plan": ("count", "measure", "schedule"), "elevation": ("count", "measure"), "civil_site": ("measure",), "schedule": ("schedule",),
    "detail": ("count", "measure"), "title_sheet": (), "roof_plan": ("count", "measure"), "mep_plan": ("count", "measure"),
}
#: Fixed values.  Words on a sheet's text, in the order in which they decide its type.
SHEET_WORDS = (
    ("title_sheet", ("INDEX", "COVER", "SHEET INDEX", "DRAWING INDEX", "TITLE SHEET")),
    ("schedule", ("SCHEDULE", "PANEL SCHEDULE", "EQUIPMENT SCHEDULE", "DOOR SCHEDULE", "WINDOW SCHEDULE", "FINISH SCHEDULE")),
    ("roof_plan", ("ROOF PLAN",)),
    ("elevation", ("ELEVATION", "ELEVATIONS")),
    ("civil_site", ("SITE PLAN", "GRADING", "UTILITY PLAN", "CIVIL PLAN", "PAVING PLAN")),
    ("detail", ("DETAIL", "DETAILS", "SECTION", "SECTIONS")),
)
#: Fixed values.  Items found in a page's text by pattern.
PAGE_TEXT_ITEMS = ((r"access\s+ladder", "Access Ladder"), (r"\bmobilization\b", "Mobilization"), (r"personnel\s+lift|material\s+lift", "Lift"))
#: Fixed values.  Units that a legend line may bear.
LEGEND_UNITS = (
    "BAG", "BF", "BOX", "CF", "CY", "DAY", "DAYS", "EA", "EACH", "GAL", "GALLONS", "HR", "LF", "LOT", "LS", "MLF", "MO", "MSF", "PAIR",
    "PR", "ROLL", "SET", "SF", "SQ", "SY", "TON", "TONS",
)
#: Fixed values.  Door materials and tags.
PANEL_MATERIALS = ("AL", "ALUM", "FRP", "GL", "GLASS", "HC", "HM", "HMG", "SCW", "WD", "WG")
FRAME_MATERIALS = ("AL", "ALUM", "GALV", "HM", "HMG", "KD", "WD")
DOOR_TAG = r"^[A-Z]{0,2}[-]?\d{1,4}[A-Z]?$|^T\d+[A-Z]?$"
#: Fixed values.  Feet that an inch of paper can stand for, and the relative tolerance of snapping to them.
SCALE_LADDER = tuple(1 / p for p in (1 / 32, 1 / 16, 3 / 32, 1 / 8, 3 / 16, 1 / 4, 3 / 8, 1 / 2, 3 / 4, 1, 1.5, 3)) + (10.0, 20.0, 30.0, 40.0, 50.0, 60.0, 80.0, 100.0, 200.0)
SCALE_TOLERANCE = 0.04
# Materials that only a door's leaf or only its frame has, and the names of all (fixed values).
PANEL_ONLY = ("FRP", "GL", "GLASS", "HC", "SCW", "WD", "WG")
FRAME_ONLY = ("GALV", "KD")
MATERIAL_LABELS = {
    "panel": {
        "AL": "Aluminum", "ALUM": "Aluminum", "FRP": "FRP", "GL": "Glass / Aluminum", "GLASS": "Glass / Aluminum", "HC": "Hollow Core Wood", "HM": "Hollow Metal",
        "HMG": "Hollow Metal (Glazed)", "SCW": "Solid Core Wood", "WD": "Wood", "WG": "Wood / Glass",
    },
    "frame": {"AL": "Aluminum", "ALUM": "Aluminum", "GALV": "Galvanized Steel", "HM": "Hollow Metal", "HMG": "Hollow Metal (Glazed)", "KD": "Knock-Down", "WD": "Wood"},
}
# Headers of a take-off table's columns, letters and digits only (fixed values).
TABLE_HEADERS = {
    "qty": ("amount", "count", "no", "nos", "qty", "quantity"),
    "item": ("desc", "description", "item", "name", "scope", "type", "work"),
    "unit": ("um", "unit", "uom"),
}
# Forms of a sheet's number, most specific first, and standards whose names look like one (fixed values).
SHEET_ID_FORMS = (r"[A-Z]\d+\.\d+", r"[A-Z]-\d+", r"[A-Z]\d{3}")
SHEET_ID_NOISE = (r"ASTM\s+[A-Z]\d+[\.\d]*", r"NFPA\s+\d+", r"UL\s+\d+", r"IBC\s+\d{4}", r"ADA\s+\d+\.\d+", r"ANSI\s+[A-Z]\d+", r"ASCE\s+\d+", r"AWC\s+NDS", r"\d{1,2}/\d{1,2}")
# File names that mark a take-off beside the plans, and those of sheet images (fixed values).
TAKEOFF_FILE = r"(?i)take\s*-?\s*offs?"
SHEET_IMAGE, PAGE_IMAGE = r"(?i)^\d{3}_(.+)\.(?:png|jpg|jpeg)$", r"(?i)^_debug_(\d+)\.(?:png|jpg|jpeg)$"
# Prices of a million tokens, in and out, of models not listed (fixed values).
DEFAULT_PRICES = (3.0, 15.0)
# Texts with digits that state no quantity (fixed values), by what they are.
NOT_QUANTITIES = {
    "elevation": r"(?i)(?:GL|INV|EL|ELEV|INV\s*IN|INV\s*OUT)\s*[=:]\s*\d",
    "percentage": r"^\d+\.?\d*\s*%$",
    "catalogue number": r"(?i)^[A-Z]+[-\s]?[A-Z]?[-\s]?\d+$",
    "compound number": r"^\S*[A-Za-z]+\d+[-/]\d+",
    "equation": r"=",
    "scale": r"(?i)scale|^(?:nts|n\.t\.s\.)$",
    "range": r"(?i) and | to ",
    "list": r"\d+\s*,\s+\d",
}
# Forms of a quantity and what their parts mean (fixed values); the first that fits counts.
QUANTITY_FORMS = (
    (r"^(\d+)\s*'\s*[-\s]?\s*(\d+(?:\.\d+)?)\s*\"?$", ("feet", "inches")),
    (r"^(\d+(?:\.\d+)?)\s*'$", ("feet",)),
    (r"^(\d+)\s*[-\s]\s*(\d+)/(\d+)\s*\"?$", ("whole", "up", "down")),
    (r"^(\d+)/(\d+)\s*\"?$", ("up", "down")),
    (r"^(\d[\d,]*(?:\.[\d,]+)?)", ("whole",)),
)
