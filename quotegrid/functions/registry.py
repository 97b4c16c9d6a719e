"""Fixed values that results depend on: venue names, title parts, source order, thresholds."""

# Canonical venue names and their other names.
VENUE_ALIASES: dict[str, tuple[str, ...]] = {
    "Apollo Victoria Theatre": (),
    "His Majesty's Theatre": (),
    "Lyceum Theatre": (),
    "Novello Theatre": (),
    "Victoria Palace Theatre": (),
    "Royal Ballet and Opera": ("Royal Opera House",),
    "Regent's Park Open Air Theatre": ("Open Air Theatre", "Open Air Theatre, Regent's Park"),
    "Troubadour Wembley Park Theatre": ("Wembley Park Theatre",),
    "Royal Festival Hall": ("Royal Festival Hall - Southbank Centre",),
    "St Paul's Church": ("St Pauls Church, Covent Garden", "St. Paul's Church"),
    "Kit Kat Club at the Playhouse Theatre": ("Kit Kat Club", "Kit Kat Club At Playhouse Theatre", "Kit Kat Club at Playhouse Theatre", "Playhouse Theatre"),
    "Theatre Royal Drury Lane": ("Drury Lane, Theatre Royal",),
    "Theatre Royal Haymarket": ("Haymarket, Theatre Royal",),
    "Sadler's Wells Theatre": ("Sadler's Wells",),
    "Shakespeare's Globe": ("Globe Theatre",),
    "London Hippodrome": ("London Hippodrome (Over 18s Only)", "Hippodrome Casino", "Hippodrome Casino (Over 18s Only)", "The Hippodrome Casino", "The Theatre at Hippodrome Casino (over 18s only)"),
    "Wilton's Music Hall": ("Wilton Music Hall",),
    "Young Vic": ("Young Vic (Main House)",),
    "Lyttelton Theatre": ("National Theatre Lyttelton",),
    "Olivier Theatre": ("National Theatre Olivier",),
    "Dorfman Theatre": ("National Theatre Dorfman",),
    "Empress Museum": ("Empress Museum, Earls Court",),
    "Menier Chocolate Factory": ("Menier Theatre (Menier Chocolate Factory)",),
    "The Arts at Marble Arch": ("The Arts at Marble Arch powered by TodayTix",),
    "Queen Elizabeth Hall": ("Queen Elizabeth Hall, Southbank Centre", "Queen Elizabeth Hall - Southbank Centre"),
    "The Old Vic": ("Old Vic", "Old Vic Theatre"),
    "The Other Palace": ("Other Palace", "The Other Palace - Main Theatre"),
    "Underbelly Boulevard Theatre": ("Underbelly Boulevard",),
    "The Vaults": ("Vaults", "The Vaults Theatre"),
    "Royal Court Theatre": ("Royal Court", "The Royal Court Theatre"),
    "Soho Place": ("@sohoplace", "@sohoplace Theatre"),
    "Barbican Theatre": ("Barbican", "Barbican Centre"),
    "Evolution London - Battersea": ("Battersea Park",),
}

# Title beginnings, articles and subtitles that a title's key leaves out.
TITLE_PREFIXES = ("disney's", "disneys", "rsc's", "rscs")
ARTICLES = ("the ", "a ", "an ")
SUBTITLES = (": the musical", ": a musical", ": a new musical", ": the pantomime", ": a pantomime", ": a comedy", ": a tragedy", ": a play", ": the play", " the musical", " the pantomime")

# Sources in their order of preference.
SOURCE_PRIORITY = ("olt", "todaytix", "lovetheatre", "seatplan", "ttd")

# Scores and counts of the entity resolution.
FUZZY_AUTO, FUZZY_REVIEW = 75, 60
LEAST_SHARED_TOKENS, LEAST_SHARED_CHARS = 2, 6
RESCUE_SCORE, RESCUE_MARGIN = 90, 5
