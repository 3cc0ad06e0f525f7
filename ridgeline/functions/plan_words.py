"""The patterns that read a plan sentence. Order within a list matters where noted."""

from __future__ import annotations

OBJECT_NOUN = (
    r"(?:vehicles?|cars?|trucks?|bus(?:es)?|vans?|suvs?|sedans?|pickups?|trailers?|traffic|objects?|cyclists?|motorcyclists?|motorcycles?|bicycl\w*|bikes?|riders?|"
    r"pedestrians?|scooters?|lead|leader|queue|convoy|ambulance|taxis?|cabs?|animals?|dogs?|persons?|people)"
)
OBJECT_ADJECTIVE = (
    r"(?:stopped|stationary|parked|halted|idling|slow|slow-moving|slowly[\s-]moving|braking|yielding|merging|crossing|oncoming|approaching|waiting|queued|queuing|turning|left-turning|right-turning|"
    r"accelerating|decelerating|cruising|moving|passing|following|creeping|reversing|backing|departing|starting|stalled|broken[\s-]down|double[\s-]parked)"
)
OBJECT_MODIFIER = (
    r"(?:lead|front|ego|white|red|black|silver|blue|gray|grey|green|yellow|orange|brown|large|small|big|dark|light|nearby|adjacent|distant|first|second|other|another|the|a|an)"
)
ARTICLE = r"(?:a|an|the|its|his|her|their|our|this|that|these|those|my|your)"
KEEP_VERB = r"(?:keep|keeps|keeping|kept|maintain|maintains|maintaining|hold|holds|holding|leave|leaving|preserve|preserving)"
LANE_VERB = KEEP_VERB + r"|stay|stays|staying|remain|remains|remaining"
ACTION_AFTER_TO = (
    r"(?:stop|stops|wait|waits|hold|halt|accelerat\w*|decelerat\w*|slow|slows|brake|brakes|speed|cruise|maintain|keep|proceed|creep|continue|resume|yield|come|reduce|ease|back|go|move|"
    r"start|remain|stay|stand|creep|coast|pick|get|queue|park)"
)
KEEP_LANE = rf"\b(?:{LANE_VERB})\s+(?:in\s+|to\s+|within\s+|on\s+)?(?:{ARTICLE}\s+)?(?:current\s+|same\s+|own\s+|left\s+|right\s+|center\s+|centre\s+|middle\s+|travel\s+|through\s+)?lanes?\b"
KEEP_SIDE = rf"\b(?:{LANE_VERB})\s+(?:to\s+the\s+|to\s+|on\s+the\s+)?(?:far\s+|slightly\s+)?(?:left|right|center|centre|middle)(?:[\s-]hand)?(?:\s+side)?\b(?!\s+lanes?\b)"

#: What other road users do, and places named after actions: masked first, in this order.
OBJECT_MASKS = (
    rf"\b{OBJECT_ADJECTIVE}\s+(?:{OBJECT_MODIFIER}\s+)*{OBJECT_NOUN}\b",
    rf"\b{OBJECT_NOUN}\s+(?:(?:that|which|who)\s+(?:is|are|was|were)\s+)?{OBJECT_ADJECTIVE}(?:\s+(?:to\s+the\s+)?(?:left|right))?\b",
    rf"\b{OBJECT_NOUN}\s+to\s+(?!(?:{ARTICLE})\s+)(?!(?:stop|wait|halt|stand|come|remain|stay)\b)[a-z]+\b[^,;]*",
    r"\bstop\s+(?:signs?|lines?|signals?|lights?|bars?)\b",
    r"\bbus\s+stops?\b",
    r"\byield\s+signs?\b",
    r"\b(?:brake|hazard|turn|tail|head|traffic|red|green|yellow|amber)\s*-?\s*lights?\b",
    r"\bcross\s*-?\s*(?:walks?|traffic|streets?|roads?|lines?)\b",
    r"\b(?:(?:left|right|u)[\s-]?)?turn(?:ing)?\s+(?:lanes?|signals?|areas?|pockets?|arrows?|bays?|only)\b",
)
#: Clauses that carry no longitudinal action: masked second, in this order.
CLAUSE_MASKS = (
    rf"\b{KEEP_VERB}\s+(?:{ARTICLE}\s+)?(?:safe\s+|proper\s+|adequate\s+|comfortable\s+|larger\s+|greater\s+|sufficient\s+|close\s+|short\s+|normal\s+)?"
    r"(?:following\s+|trailing\s+)?(?:distance|gap|space|clearance|buffer|headway)\b",
    KEEP_LANE,
    KEEP_SIDE,
    r"\bwithout\s+(?:stopping|waiting|slowing|braking|accelerating|decelerating|yielding|halting|pausing)\b",
    rf"\bto\s+(?!{ARTICLE}\b)(?!{ACTION_AFTER_TO}\b)[a-z]+\b[^,;]*",
)
STRONG = (
    (
        "stop",
        r"\bstops?\b|\bstopp(?:ed|ing)\b|\bwait(?:s|ed|ing)?\b|\bhold(?:s|ing)?\b(?!\s+(?:the\s+|current\s+|a\s+|steady\s+|its\s+)?(?:speed|pace|lane))|\bhalt(?:s|ed|ing)?\b|\bstand(?:s|ing)?\s+still\b|\bstandstill\b"
        r"|\b(?:remain|remains|remaining|stay|stays|staying)\s+(?:stopped|stationary|halted|still|put|parked|at\s+rest|in\s+place|motionless)\b|\bstationary\b|\bmotionless\b|\bqueue(?:s|d)?\b|\bqueuing\b|\bqueueing\b"
        r"|\bidl(?:e|es|ing)\b|\bpark(?:s|ed|ing)?\b(?!\s+(?:lot|lots|space|spaces|spot|spots|area|areas|garage|structure))"
        rf"|\blet(?:s|ting)?\s+(?:{ARTICLE}\s+)?(?:[a-z-]+\s+){{0,4}}?(?:cross|pass|clear|go|through|merge|proceed|turn|enter|exit|finish|complete|move)\b",
    ),
    (
        "decelerate",
        r"\bdec+eler\w*|\bdecelar\w*|\bslow(?:s|ed|ing)?\b|\bbrak(?:e|es|ed|ing)\b|\byield(?:s|ed|ing)?\b|\bgiv(?:e|es|ing)\s+way\b|\bgave\s+way\b|\beas(?:e|es|ed|ing)\s+(?:off|up)\b"
        r"|\breduc(?:e|es|ing)\s+(?:the\s+|its\s+|your\s+)?speed\b|\bback(?:s|ed|ing)?\s+off\b|\bapproach(?:es|ed|ing)?\s+(?:cautiously|slowly|carefully|with\s+caution)\b|\bcautiously\s+approach\w*",
    ),
    (
        "accelerate",
        r"\bac+eler\w*|\bspeed(?:s|ing)?\s+up\b|\bstart(?:s|ed|ing)?\b(?!\s+(?:to\s+)?(?:brak|slow|decel|stopp|wait|yield))|\bmov(?:e|es|ed|ing)\s+off\b|\bpull(?:s|ed|ing)?\s+away\b|\bresum(?:e|es|ed|ing)\b"
        r"|\blaunch(?:es|ed|ing)?\b|\bpull(?:s|ed|ing)?\s+out\b|\bget(?:s|ting)?\s+going\b|\bset(?:s|ting)?\s+off\b|\btak(?:e|es|ing)\s+off\b|\bpick(?:s|ed|ing)?\s+up\s+speed\b"
        r"|\bincreas(?:e|es|ed|ing)\s+(?:the\s+|its\s+)?speed\b|\bgo\s+faster\b|\bdepart(?:s|ed|ing)?\b|\bbegin(?:s|ning)?\s+(?:moving|to\s+move|rolling)\b",
    ),
    (
        "keep",
        r"\bcruis(?:e|es|ed|ing)\b|\bmaintain(?:s|ed|ing)?\b|\bkeep(?:s|ing)?\s+(?:the\s+|its\s+|current\s+|a\s+|your\s+)?(?:pace|speed|momentum)\b|\bkeep(?:s|ing)?\s+(?:going|moving|driving|rolling|cruising|up)\b"
        r"|\bhold(?:s|ing)?\s+(?:the\s+|current\s+|a\s+|steady\s+|its\s+)?(?:speed|pace)\b|\bcoast(?:s|ed|ing)?\b|\b(?:steady|constant|same|current|low|moderate|slow|reduced|walking|crawling)\s+(?:speed|pace)\b",
    ),
)
#: Count only without a strong word. "split" is accelerate from a stop and keep while moving.
WEAK = (
    (
        "split",
        r"\bproceed(?:s|ed|ing)?\b|\bgo(?:es|ing)?\b|\bwent\b|\bcreep(?:s|ing)?\b|\bcrept\b|\bmov(?:e|es|ed|ing)\b|\bdriv(?:e|es|ing)\b|\bdrove\b|\badvanc(?:e|es|ed|ing)\b|\broll(?:s|ed|ing)?\b"
        r"|\bhead(?:s|ed|ing)?\b|\btravel(?:s|ed|led|ing|ling)?\b|\bcross(?:es|ed|ing)?\b|\benter(?:s|ed|ing)?\b|\btravers\w*|\bnavigat\w*|\bnegotiat\w*|\binch(?:es|ed|ing)?\s+forward\b",
    ),
    ("keep", r"\bcontinu(?:e|es|ed|ing)\b|\bfollow(?:s|ed|ing)?\b|\bpass(?:es|ed|ing)?\b|\bovertak\w*|\bbypass\w*"),
)
#: Count only without any word above.
FALLBACK = (
    ("stop", r"\bstill\b|\bstand\b|\bno\s+movement\b|\bfreeze\w*|\bpaus\w*"),
    ("decelerate", r"\bcautious\w*|\bcareful\w*|\bgentl\w*|\beas(?:e|y|ing)\b|\breduc\w*|\blower\w*|\blet\b|\bsoft\w*|\bback\s+away"),
    ("accelerate", r"\bfaster\b|\bquick\w*|\bincreas\w*|\bpick\w*\s+up\b|\bget\s+moving\b|\bcommenc\w*|\bbegin\w*|\bboost\w*|\bpush\w*"),
    ("keep", r"\bsteady\b|\bconstant\b|\bsame\s+speed\b|\bmomentum\b|\bpace\b|\btrack\w*\b|\bkeep\w*\b|\bcontinu\w*"),
)
TURN = (
    r"\bturn(?:s|ed|ing)?\s+(?:to\s+the\s+|to\s+|towards?\s+the\s+|towards?\s+)?(?P<a>left|right)\b|\b(?P<b>left|right)(?:[\s-]hand)?[\s-]turns?\b"
    r"|\b(?:veer|veers|veered|veering|bear|bears|bearing|steer|steers|steering|swing|swings|swinging|curve|curves|curving)\s+(?:to\s+the\s+|to\s+)?(?P<c>left|right)\b|\b(?P<u>u)[\s-]?turns?\b"
)
NOTES = (
    ("lane_change", r"\blane[\s-]chang\w*|\bchang(?:e|es|ed|ing)\s+(?:the\s+|a\s+|to\s+the\s+)?lanes?\b|\bmerg\w*"),
    ("nudge", r"\bnudg\w*"),
    ("borrow", r"\bborrow\w*|\blane[\s-]borrow\w*"),
    ("pull_over", r"\bpull(?:s|ed|ing)?\s+over\b"),
    ("pull_out", r"\bpull(?:s|ed|ing)?\s+out\b"),
    ("reverse", r"\brevers\w*|\bback(?:s|ed|ing)?\s+up\b|\bbacking\b|\bbackwards?\b"),
    ("keep_lane", KEEP_LANE),
    ("keep_side", KEEP_SIDE),
    ("straight", r"\bstraight\b"),
)

#: Fixed patterns of the phrase scan: words that join clauses, verbs that begin one, prepositions; where a phrase's object ends.
_JOINS = r"(?:and|then|while|until|till|before|after|as|so|because|once|when|if|but|or)"
_SIDE_VERBS = r"(?:turn|turning|turns|change|changing|changes|merge|merging|nudge|nudging|pull|pulling|veer|veering|bear|bearing|keep|keeping|stay|staying|maintain|maintaining|hold|holding)"
_PREPOSITIONS = r"(?:for|behind|at|before|until|till|to|in\s+front\s+of|near|by|with|through|past|along|into|onto|towards?|across|over|from|around|after|on|under|beyond|up\s+to)"
_NO_STOP_NOUN = r"(?!\s+(?:sign|signs|line|lines|light|lights|signal|signals|vehicle|vehicles|car|cars|truck|bus|traffic|lead))"
_OBJECT_END = rf"(?=,|;|\.|:|$|\s+{_JOINS}\b|\s+(?:to\s+)?{_SIDE_VERBS}\b)"
OBJECTS = {
    "prep": rf"(?:\s+{_PREPOSITIONS}\b[^,;.:]*?{_OBJECT_END})?",
    "always": rf"(?:\s+(?!{_JOINS}\b)(?!(?:to\s+)?{_SIDE_VERBS}\b)[^,;.:]*?{_OBJECT_END})?",
    None: "",
}
#: Fixed patterns: phrases in order, each with its class and which object belongs to it; at one place the first one wins. Their groups have no names, as all stand in one alternation.
PHRASES = (
    (r"(?:decelerat\w*|slow\w*(?:\s+down)?|brak\w*|com(?:e|es|ing)|came)\s+to\s+a\s+(?:complete\s+|full\s+)?(?:stop|halt|standstill)", "stop", "prep"),
    (r"(?:remain|remains|remaining|stay|stays|staying|stand|stands|standing|keep|keeps|keeping|continue|continues|continuing)\s+(?:stopped|still|stationary|halted|parked|waiting|at\s+a\s+standstill|to\s+wait)", "stop", "prep"),
    (r"pull(?:s|ed|ing)?\s+over\s+and\s+stop(?:s|ped)?", "stop", "prep"),
    (r"stand\s*still", "stop", None),
    (r"stay\s+put", "stop", None),
    (r"hold(?:s|ing)?\s+(?:the\s+|its\s+)?position", "stop", None),
    (r"do\s+not\s+(?:move|proceed|go|enter)", "stop", "prep"),
    (rf"(?<!the )(?<!a )(?<!an )stop(?:s|ped|ping)?\b{_NO_STOP_NOUN}", "stop", "prep"),
    (r"wait(?:s|ed|ing)?\b", "stop", "prep"),
    (r"hold(?:s|ing)?\b(?!\s+(?:the\s+)?lane)", "stop", "prep"),
    (r"halt(?:s|ed|ing)?\b(?!\s+(?:sign|line))", "stop", "prep"),
    (r"idl(?:e|es|ing)\b", "stop", None),
    (r"decelerat\w*", "decelerate", "prep"),
    (r"slow(?:n|s|ed|ing)?(?:\s+down)?\b(?!\s+(?:traffic|vehicle|vehicles|car|cars|moving|-moving|lane|speed))", "decelerate", "prep"),
    (r"brak(?:e|es|ed|ing)\b(?!\s+light)", "decelerate", "prep"),
    (r"yield(?:s|ed|ing)?\b(?!\s+sign)", "decelerate", "prep"),
    (r"giv(?:e|es|ing)\s+way", "decelerate", "prep"),
    (r"eas(?:e|es|ed|ing)\s+off", "decelerate", "prep"),
    (r"reduc(?:e|es|ed|ing)\s+(?:the\s+|its\s+)?speed", "decelerate", "prep"),
    (r"approach(?:es|ed|ing)?\s+(?:cautiously|slowly|carefully)", "decelerate", "prep"),
    (r"approach(?:es|ed|ing)?\s+[^,;.:]*?\s+(?:cautiously|slowly|carefully)", "decelerate", None),
    (r"back(?:s|ed|ing)?\s+off", "decelerate", "prep"),
    (r"cruis(?:e|es|ed|ing)\b", "keep", "prep"),
    (r"maintain(?:s|ed|ing)?\b(?!\s+(?:the\s+)?lane)", "keep", "always"),
    (r"keep(?:s|ing)?\s+(?:the\s+|a\s+|its\s+|current\s+)?(?:pace|speed|moving|going|rolling|cruising|driving|(?:safe\s+)?distance|(?:safe\s+)?gap|following)\b", "keep", "prep"),
    (r"(?<!the )(?<!a )follow(?:s|ed|ing)?\b", "keep", "always"),
    (r"continu(?:e|es|ed|ing)\b(?!\s+straight)", "keep", "prep"),
    (r"go(?:es|ing)?\s+through\b", "keep", "prep"),
    (r"(?<!the )(?<!a )pass(?:es|ed|ing)?\b(?!enger)", "keep", "always"),
    (r"coast(?:s|ed|ing)?\b", "keep", "prep"),
    (r"accelerat\w*", "accelerate", "prep"),
    (r"speed(?:s|ed|ing)?\s+up\b", "accelerate", "prep"),
    (r"start(?:s|ed|ing)?\b(?!\s+of\b)", "accelerate", "always"),
    (r"mov(?:e|es|ed|ing)\s+(?:off|out|on)\b", "accelerate", "prep"),
    (r"pull(?:s|ed|ing)?\s+away\b", "accelerate", "prep"),
    (r"resum(?:e|es|ed|ing)\b", "accelerate", "always"),
    (r"launch(?:es|ed|ing)?\b", "accelerate", "prep"),
    (r"pull(?:s|ed|ing)?\s+out(?:\s+(?:to\s+the\s+)?(?:left|right))?\b", "accelerate", "prep"),
    (r"get(?:s|ting)?\s+going\b", "accelerate", None),
    (r"set(?:s|ting)?\s+off\b", "accelerate", None),
    (r"depart\w*", "accelerate", "prep"),
    (r"proceed(?:s|ed|ing)?\b", "v0", "prep"),
    (r"creep(?:s|ed|ing)?(?:\s+forward)?\b", "v0", "prep"),
    (r"go(?:es|ing)?\s+straight\b", "v0", "prep"),
    (r"continu(?:e|es|ed|ing)\s+straight\b", "v0", "prep"),
    (r"go(?:es|ing)?\b(?!\s+(?:through|around|past|left|right|straight))", "v0", "prep"),
    (r"mov(?:e|es|ed|ing)\s+(?:forward|ahead)\b", "v0", "prep"),
    (r"driv(?:e|es|ing)\b", "v0", "prep"),
    (r"advanc(?:e|es|ed|ing)\b", "v0", "prep"),
    (r"travel(?:s|led|ling|ed|ing)?\b", "v0", "prep"),
    (r"roll(?:s|ed|ing)?\s+(?:forward|through|over|on)\b", "v0", "prep"),
    (r"u-?\s?turn(?:s|ing)?\b", "lat_left", None),
    (r"turn(?:s|ed|ing)?\s+(?:to\s+the\s+)?(?:left|right)\b", "lat", None),
    (r"(?:left|right)(?:-|\s+)(?:hand\s+)?turn(?:s|ing)?\b", "lat", None),
    (r"veer(?:s|ed|ing)?\s+(?:to\s+the\s+)?(?:left|right)\b", "lat", None),
    (r"bear(?:s|ing)?\s+(?:to\s+the\s+)?(?:left|right)\b", "lat", None),
    (r"go(?:es|ing)?\s+(?:left|right)\b", "lat", None),
    (r"lane\s+chang\w*|chang(?:e|es|ing)\s+(?:to\s+the\s+)?(?:left\s+|right\s+)?lanes?\b|chang(?:e|es|ing)\s+lanes?\b", "note:lane_change", None),
    (r"merg(?:e|es|ing)\b", "note:merge", None),
    (r"nudg(?:e|es|ing)\b", "note:nudge", None),
    (r"borrow\w*", "note:borrow", None),
    (r"pull(?:s|ed|ing)?\s+over\b", "note:pull_over", None),
    (r"go(?:es|ing)?\s+around\b|bypass\w*|overtak\w*", "note:go_around", None),
    (r"(?:keep|stay|remain|hold|maintain)\w*\s+(?:in\s+)?(?:the\s+|its\s+|current\s+)?lane\b", "note:lane_keep", None),
    (r"\bstraight\b", "note:straight", None),
)
