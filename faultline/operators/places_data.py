"""Places and hand-made classifications of place texts. Fixed values."""

# Country, latitude, longitude, name.
COUNTRIES = (
    ("US", 39.8283, -98.5795, "United States"),
    ("AU", -25.2744, 133.7751, "Australia"),
    ("CA", 56.1304, -106.3468, "Canada"),
    ("CN", 35.8617, 104.1954, "China"),
)
# Region, country, latitude, longitude, name.
REGIONS = (
    ("AZ", "US", 33.4484, -112.074, "Arizona"),
    ("CA", "US", 38.5816, -121.4944, "California"),
    ("TX", "US", 30.2672, -97.7431, "Texas"),
    ("NV", "US", 39.1638, -119.7674, "Nevada"),
    ("GA", "US", 33.749, -84.388, "Georgia"),
    ("FL", "US", 30.4383, -84.2807, "Florida"),
    ("MI", "US", 42.7325, -84.5555, "Michigan"),
    ("DC", "US", 38.9072, -77.0369, "District of Columbia"),
    ("MN", "US", 44.9537, -93.09, "Minnesota"),
    ("TN", "US", 36.1627, -86.7816, "Tennessee"),
    ("PA", "US", 40.2732, -76.8867, "Pennsylvania"),
    ("CO", "US", 39.7392, -104.9903, "Colorado"),
    ("NM", "US", 35.687, -105.9378, "New Mexico"),
    ("WA", "US", 47.0379, -122.9007, "Washington"),
    ("IN", "US", 39.7684, -86.1581, "Indiana"),
    ("MS", "US", 32.2988, -90.1848, "Mississippi"),
    ("AR", "US", 34.7465, -92.2896, "Arkansas"),
    ("OH", "US", 39.9612, -82.9988, "Ohio"),
    ("RI", "US", 41.824, -71.4128, "Rhode Island"),
    ("OK", "US", 35.4676, -97.5164, "Oklahoma"),
    ("WY", "US", 41.14, -104.8202, "Wyoming"),
)
# City, region if there is one, country, latitude, longitude.
CITIES = (
    ("San Francisco", "CA", "US", 37.7749, -122.4194),
    ("Los Angeles", "CA", "US", 34.0522, -118.2437),
    ("Austin", "TX", "US", 30.2672, -97.7431),
    ("Phoenix", "AZ", "US", 33.4484, -112.074),
    ("Tempe", "AZ", "US", 33.4255, -111.94),
    ("Atlanta", "GA", "US", 33.749, -84.388),
    ("Las Vegas", "NV", "US", 36.1699, -115.1398),
    ("Scottsdale", "AZ", "US", 33.4942, -111.9261),
    ("Dallas", "TX", "US", 32.7767, -96.797),
    ("Miami", "FL", "US", 25.7617, -80.1918),
    ("Santa Monica", "CA", "US", 34.0195, -118.4912),
    ("Houston", "TX", "US", 29.7604, -95.3698),
    ("Chandler", "AZ", "US", 33.3062, -111.8413),
    ("Mesa", "AZ", "US", 33.4152, -111.8315),
    ("Culver City", "CA", "US", 34.0211, -118.3965),
    ("Mountain View", "CA", "US", 37.3861, -122.0839),
    ("Inglewood", "CA", "US", 33.9617, -118.3531),
    ("Beverly Hills", "CA", "US", 34.0736, -118.4004),
    ("West Hollywood", "CA", "US", 34.09, -118.3617),
    ("Paradise", "NV", "US", 36.0839, -115.1425),
    ("Venice", "CA", "US", 33.985, -118.4695),
    ("Palo Alto", "CA", "US", 37.4419, -122.143),
    ("Daly City", "CA", "US", 37.6879, -122.4702),
    ("San Jose", "CA", "US", 37.3382, -121.8863),
    ("Orlando", "FL", "US", 28.5383, -81.3792),
    ("Arlington", "TX", "US", 32.7357, -97.1081),
    ("South San Francisco", "CA", "US", 37.6547, -122.4077),
    ("Santa Clara", "CA", "US", 37.3541, -121.9552),
    ("Washington", "DC", "US", 38.9072, -77.0369),
    ("Ann Arbor", "MI", "US", 42.2808, -83.743),
    ("Spring Valley", "NV", "US", 36.1097, -115.2564),
    ("Sunnyvale", "CA", "US", 37.3688, -122.0363),
    ("Nashville", "TN", "US", 36.1627, -86.7816),
    ("Paradise Valley", "AZ", "US", 33.5312, -111.9412),
    ("Jacksonville", "FL", "US", 30.3322, -81.6557),
    ("Redwood City", "CA", "US", 37.4852, -122.2364),
    ("Peachtree Corners", "GA", "US", 33.9698, -84.2227),
    ("Miami Beach", "FL", "US", 25.7907, -80.13),
    ("Grand Rapids", "MN", "US", 47.2372, -93.53),
    ("San Mateo", "CA", "US", 37.563, -122.3255),
    ("San Antonio", "TX", "US", 29.4241, -98.4936),
    ("Ennis", "TX", "US", 32.3293, -96.6252),
    ("San Bruno", "CA", "US", 37.6305, -122.4111),
    ("Fremont", "CA", "US", 37.5485, -121.9886),
    ("Huntsville", "TX", "US", 30.7235, -95.5508),
    ("Brisbane", "CA", "US", 37.6838, -122.3997),
    ("Emeryville", "CA", "US", 37.8313, -122.2852),
    ("Menlo Park", "CA", "US", 37.453, -122.1817),
    ("Burlingame", "CA", "US", 37.5779, -122.3484),
    ("Sun City", "AZ", "US", 33.5964, -112.2716),
    ("Sacaton", "AZ", "US", 33.0834, -111.7423),
    ("Streetman", "TX", "US", 31.9793, -96.3197),
    ("Buffalo", "TX", "US", 31.4571, -96.0625),
    ("Aledo", "TX", "US", 32.6976, -97.6011),
    ("Golden", "CO", "US", 39.7555, -105.2211),
    ("Centerville", "TX", "US", 31.2604, -95.9536),
    ("Marina Del Rey", "CA", "US", 33.9802, -118.4517),
    ("Indianapolis", "IN", "US", 39.7684, -86.1581),
    ("Pittsburgh", "PA", "US", 40.4406, -79.9959),
    ("Gilbert", "AZ", "US", 33.3528, -111.789),
    ("Denver", "CO", "US", 39.7392, -104.9903),
    ("Spring", "TX", "US", 30.0799, -95.4172),
    ("Guadalupe", "AZ", "US", 33.3542, -111.9598),
    ("Washington DC", "DC", "US", 38.9072, -77.0369),
    ("Philadelphia", "PA", "US", 39.9526, -75.1652),
    ("Seattle", "WA", "US", 47.6062, -122.3321),
    ("Vancouver", None, "CA", 49.2827, -123.1207),
    ("Quzhou", None, "CN", 28.97, 118.87),
)
# Place text of a curated event, country, key of the place it stands for (none: it can't be placed), and why.
OVERRIDES = (
    ("Austin, Texas, USA", "US", "AUSTIN|TX|US", "city, state and country"),
    ("Australia", "AU", "AU", "a country"),
    (None, None, None, "no text"),
    ("Bruce Highway, Australia", "AU", "AU", "a long road; no one point of it can be defended"),
    ("Brisbane Inner City Bypass, Australia", "AU", "AU", "a road without a place of its own here"),
    ("University of Queensland, St Lucia, Brisbane, Australia", "AU", "AU", "a campus without a place of its own here"),
    ("GA-575, north of Atlanta, Georgia, USA", "US", "GA|US", "a road outside the city that it names"),
    ("Canada", "CA", "CA", "a country"),
    ("Reported as probably Thailand; not confirmed", None, None, "a guess"),
    ("United States", "US", "US", "a country"),
    ("Vancouver, Canada", "CA", "VANCOUVER|CA", "a city"),
    ("Quzhou, China", "CN", "QUZHOU|CN", "a city"),
    ("Phoenix, Arizona, USA", "US", "PHOENIX|AZ|US", "city, state and country"),
    ("Austin, Texas", "US", "AUSTIN|TX|US", "city and state"),
    ("Santa Monica, California, USA", "US", "SANTA MONICA|CA|US", "city, state and country"),
    ("San Francisco, California, USA", "US", "SAN FRANCISCO|CA|US", "city, state and country"),
)
