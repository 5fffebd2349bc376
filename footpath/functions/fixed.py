"""Fixed values that results must agree on."""

# Way types that can be walked, and those that never can.
WALKABLE = (
    "footway", "path", "pedestrian", "residential", "living_street", "tertiary", "secondary", "primary", "trunk",
    "steps", "cycleway", "unclassified", "service", "track", "tertiary_link", "secondary_link", "primary_link",
)
EXCLUDED = ("motorway", "motorway_link")

# Access tags that close a way, and foot tags that open it again.
CLOSED = ("private", "no")
OPENED = ("yes", "designated", "permissive")

# Bounding box in degrees.
BBOX = {"min_lat": 37.20, "max_lat": 38.35, "min_lon": -122.65, "max_lon": -121.70}

# Mean radius of the earth and metres of a degree.
EARTH_RADIUS_M = 6371000.0
METRES_PER_DEGREE = 111320.0

# What a way without a name is called.
DESCRIPTIONS = {
    "footway": "footpath",
    "path": "path",
    "pedestrian": "pedestrian way",
    "steps": "steps",
    "cycleway": "cycleway",
    "residential": "road",
    "living_street": "road",
    "tertiary": "road",
    "tertiary_link": "road",
    "secondary": "road",
    "secondary_link": "road",
    "primary": "road",
    "primary_link": "road",
    "trunk": "road",
    "service": "service road",
    "track": "track",
    "unclassified": "road",
}

# Names of the eight compass sectors, and how an instruction begins.
COMPASS = ("north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest")
PREFIXES = {
    "start": "Head",
    "straight": "Continue",
    "slight_left": "Turn slight left",
    "slight_right": "Turn slight right",
    "left": "Turn left",
    "right": "Turn right",
    "sharp_left": "Turn sharp left",
    "sharp_right": "Turn sharp right",
    "u_turn": "Make a U-turn",
    "arrive": "Arrive",
}

# Penalties of the search for routes that avoid walked edges, and scales of detours.
FALLBACK_PENALTIES = (1.5, 2.0, 3.0, 5.0, 8.0)
DETOUR_SCALES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.15)

# Walking speeds of the command line (km/h) and of the report (m/s).
CLI_KMH, REPORT_MPS = 5.0, 1.4

# Thresholds of the report.
SNAP_WARN_M, SNAP_LIMIT_M, SHORTEST_LIMIT_S, NOVELTY_LIMIT_S, SAME_ROUTE_M = 100.0, 200.0, 30.0, 60.0, 1.0

# The twenty pairs of the report, by name, start and end in degrees, and roughly how many kilometres.
REPORT_ROUTES = (
    ("Ferry Building to Embarcadero Center", 37.7955, -122.3937, 37.7946, -122.4010, 1.0),
    ("Castro to Dolores Park", 37.7609, -122.4350, 37.7596, -122.4269, 1.0),
    ("North Beach to Chinatown", 37.8005, -122.4102, 37.7941, -122.4068, 1.0),
    ("Union Square to Civic Center", 37.7879, -122.4074, 37.7793, -122.4193, 2.0),
    ("Marina to Fisherman's Wharf", 37.8010, -122.4370, 37.8080, -122.4177, 2.0),
    ("Mission to Potrero Hill", 37.7599, -122.4148, 37.7614, -122.3929, 2.0),
    ("UCSF to Twin Peaks", 37.7631, -122.4586, 37.7544, -122.4477, 3.0),
    ("Haight to SoMa", 37.7692, -122.4481, 37.7785, -122.4055, 3.0),
    ("Noe Valley to Mission Bay", 37.7502, -122.4337, 37.7706, -122.3930, 3.5),
    ("Golden Gate Park East to Ferry Building", 37.7694, -122.4530, 37.7955, -122.3937, 5.0),
    ("Sunset District to Haight-Ashbury", 37.7535, -122.4900, 37.7692, -122.4481, 4.0),
    ("Presidio to Marina", 37.7989, -122.4662, 37.8010, -122.4370, 4.0),
    ("Richmond to North Beach", 37.7800, -122.4650, 37.8005, -122.4102, 5.5),
    ("Bayview to Mission", 37.7340, -122.3920, 37.7599, -122.4148, 5.0),
    ("Glen Park to Castro", 37.7340, -122.4330, 37.7609, -122.4350, 5.0),
    ("Ocean Beach to Embarcadero", 37.7604, -122.5097, 37.7946, -122.4010, 8.0),
    ("Presidio to Mission Dolores", 37.7989, -122.4662, 37.7596, -122.4269, 7.0),
    ("Golden Gate Bridge to Dogpatch", 37.8078, -122.4750, 37.7578, -122.3870, 10.0),
    ("Lands End to AT&T Park", 37.7867, -122.5054, 37.7786, -122.3893, 10.0),
    ("Outer Sunset to Embarcadero", 37.7535, -122.5050, 37.7946, -122.4010, 10.0),
)

# The pair of the sweep (start and end in degrees), its minutes on top, and the novelty that it asks for.
SWEEP_PAIR = (37.7425, -122.4555, 37.7440, -122.4625)
SWEEP_MINUTES, SWEEP_NOVELTY = (5, 10, 15, 20, 30), 0.15
