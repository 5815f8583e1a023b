"""Stopword lists and their unions."""

# Results depend on exactly these words.
ENGLISH = """
a about above after again against all am an and any are aren't as at be because been before being below
between both but by can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further
had hadn't has hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd
i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on once only
or other ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than that
that's the their theirs them themselves then there there's these they they'd they'll they're they've this those through to
too under until up very was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while
who who's whom why why's with won't would wouldn't you you'd you'll you're you've your yours yourself yourselves
""".split()

# Fixed values.
GERMAN = """
aber alle als also am an ander andere anderes anderm anderen anderr andern auch auf aus bei bin bis bist da
dadurch dafür dagegen daher darum das dass de der den des dem die dies dieser dieses deren dessen dich dir doch dort du
durch ein eine einem einen einer eines er es etwas euer eure euren eurer eures für gegen gewesen habe haben hat hatte
hatten hier hin hinter ich ihr ihre ihren ihrer ihres im in ist ja jede jedem jeden jeder jedes jener jenes jetzt kann
kannst kein keine keinem keinen keiner keines man mehr mein meine meiner meines mich mir mit muss musst mussten nach
nicht noch nur ob oder ohne sehr seid sein seine seiner seines selbst sich sie sind so solche solchen solcher solches
soll sollen sollst sollt sondern um und uns unser unsere unseren unserer unseres unter vom von vor wann war waren
warst was weg weil weiter wenn wer werde werden werdet wir wird wirst wo wurde wurden zu zum zur zwar zwischen
""".split()

# Words that crowd topic labels of research texts.
DOMAIN = """
study studies dataset datasets data result results analysis analyses method methods approach approaches using model models
effect effects impact impacts evidence significant related associated
""".split()

#: The goal and anchor-cluster labellers also drop this one.
DOMAIN_BASED = [*DOMAIN, "based"]
#: The label refiner adds these and has no domain list.
REFINER_EXTRA = ["let", "anders"]

_BY_LANGUAGE = {"en": ENGLISH, "de": GERMAN}


def union(languages: str = "en,de", extra: str = "", domain: list[str] = DOMAIN) -> list[str]:
    """The union for comma-separated languages, the domain list and comma-separated extra words, lower-case and sorted."""
    words = set(domain)
    for language in languages.split(","):
        words |= set(_BY_LANGUAGE.get(language.strip().lower(), []))
    return sorted(words | {w.strip().lower() for w in extra.split(",") if w.strip()})
