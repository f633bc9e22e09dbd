"""Word lists, closed vocabularies and lookup tables that results must agree with."""

# Fields of a slim record.
SLIM_FIELDS = [
    "id", "doi", "display_name", "title", "publication_year", "publication_date", "type", "language",
    "primary_location", "locations", "best_oa_location", "open_access", "authorships", "topics", "concepts",
    "keywords", "abstract_inverted_index", "biblio", "cited_by_count", "counts_by_year", "is_retracted",
    "is_paratext", "referenced_works", "related_works", "grants", "mesh", "primary_topic", "indexed_in",
    "updated_date", "created_date",
]

# Record types that pass the structural filter.
RECORD_TYPES = [
    "article", "preprint", "book", "book-chapter", "dataset", "dissertation", "review",
    "proceedings-article", "report", "standard", "other",
]

# Summaries that mark a reply that is none.
FAILURE_MARKERS = ["silent_failure", "parse_error", "rejected", "", "template_leak"]
COPIED_SUMMARIES = [
    "not relevant: industrial gearbox vibration analysis, no animal data",
    "not relevant: pure industrial vibration analysis, no animal data",
]

# Closed vocabularies of a model reply.
SOCIAL_SCALES = ["individual", "dyadic", "group", "population", "community", "cross-species", "not_applicable"]
TRADITIONS = ["biological", "computational", "hybrid"]
PAPER_TYPES = ["empirical", "dataset", "method", "review", "theoretical", "tool", "irrelevant"]
MODALITIES = ["Acoustic", "Visual", "Chemical", "Tactile", "Seismic", "Electrical", "Multimodal", "Other"]
CONTEXTS = [
    "Field / Wild", "Lab / Controlled", "Captive / Zoo", "Passive Acoustic Mon.", "Playback Experiment",
    "Citizen Science", "Simulation / Synthetic", "Existing Dataset", "Other",
]
DOMAINS = [
    "Species Identification", "Individual ID", "Conservation & Ecology", "Animal Welfare", "Decoding / Translation",
    "Vocal Learning & Culture", "Human-Animal Interaction", "Cross-Species Interaction", "Neuroscience",
    "Bioacoustic Methods", "Soundscape Ecology", "Noise & Anthropogenic", "Other",
]
FEATURES = [
    "Vocal Auditory Channel", "Turn-taking", "Reference", "Displacement", "Syntax", "Recursion", "Semanticity",
    "Cultural Transmission", "Vocal Learning", "Discreteness", "Individual Variation", "Dialect", "Emotion/Affect",
]
STAGES = [
    "Data Collection", "Preprocessing", "Sequence Representation", "Analysis & Classification",
    "Meaning Identification", "Generation", "Foundation Model",
]
BAT_WORDS = [
    "bat", "bats", "chiroptera", "chiropteran", "myotis", "eptesicus", "rhinolophus", "pteropus", "tadarida",
    "noctilio", "pipistrellus", "molossus", "vespertilionidae", "phyllostomidae", "pteropodidae",
]

# Labels that stand for nothing.
NULLISH = [
    "na", "n/a", "none", "null", "unknown", "unk", "undefined", "not_applicable", "not applicable",
    "not-applicable", "n.a.", "notapplicable",
]
SPECIES_NULLISH = [*NULLISH, "other", "others", "other species", "misc", "miscellaneous", "unspecified", "multiple", "various", "several"]

# Names and their labels.
SPECIES_SYNONYMS = {
    "taeniopygia guttata": "Zebra finch",
    "poephila guttata": "Zebra finch",
    "mus musculus": "House mouse",
    "rattus norvegicus": "Norway rat",
    "pan troglodytes": "Chimpanzee",
    "tursiops truncatus": "Bottlenose dolphin",
    "physeter macrocephalus": "Sperm whale",
    "megaptera novaeangliae": "Humpback whale",
    "orcinus orca": "Killer whale",
    "apis mellifera": "Honeybee",
    "drosophila melanogaster": "Fruit fly",
    "columba livia": "Rock pigeon",
    "melospiza melodia": "Song sparrow",
    "serinus canaria": "Domestic canary",
    "canis lupus familiaris": "Dog",
    "canis familiaris": "Dog",
    "felis catus": "Domestic cat",
    "xenopus laevis": "African clawed frog",
    "homo sapiens": "Human",
}
TAXON_GROUPS = {"whale": "Whale", "porpoise": "Porpoise", "bat": "Bat"}
VENUE_SHORT = {
    "the journal of the acoustical society of america": "J. Acoust. Soc. Am.",
    "proceedings of the royal society b biological sciences": "Proc. R. Soc. B",
}
TRADITION_ALIASES = {
    "biological": "biological",
    "bio": "biological",
    "biology": "biological",
    "computational": "computational",
    "comp": "computational",
    "ml": "computational",
    "nlp": "computational",
    "hybrid": "hybrid",
    "bio+comp": "hybrid",
    "computational+biological": "hybrid",
    "biological+computational": "hybrid",
}
TOKEN_FORMS = {
    "bats": "bat", "whales": "whale", "dolphins": "dolphin", "birds": "bird", "frogs": "frog", "mice": "mouse",
    "rats": "rat", "seals": "seal", "finches": "finch", "sparrows": "sparrow", "monkeys": "monkey",
    "crickets": "cricket", "insects": "insect", "fishes": "fish", "songbirds": "songbird", "warblers": "warbler",
    "porpoises": "porpoise", "primates": "primate", "cetaceans": "cetacean", "elephants": "elephant",
    "orcas": "orca", "bees": "bee", "grasshoppers": "grasshopper", "gerbils": "gerbil", "canaries": "canary",
    "wolves": "wolf", "crows": "crow", "ravens": "raven", "parrots": "parrot", "chimpanzees": "chimpanzee",
    "gorillas": "gorilla", "males": "male", "females": "female", "responses": "response", "neurons": "neuron",
    "pulses": "pulse", "clicks": "click", "whistles": "whistle", "chirps": "chirp", "repertoires": "repertoire",
    "syllables": "syllable", "echolocate": "echolocation", "focusing": "focus", "producing": "produce",
    "produced": "produce", "measuring": "measure", "measured": "measure", "detecting": "detect",
    "detected": "detect", "recognizing": "recognize", "recognised": "recognize", "monitoring": "monitor",
}

# First years of the report's periods.
PERIOD_EDGES = [1980, 1990, 2000, 2010, 2020]
