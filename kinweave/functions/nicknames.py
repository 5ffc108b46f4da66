"""A small table of English nicknames; replace it by passing another."""

from __future__ import annotations

#: Formal given names with nicknames and written abbreviations.
NICKNAMES = {
    "alexander": "alex xander sandy alec lex al",
    "alexandra": "alex lexie sandra sandy alexa lexi",
    "anthony": "tony ant",
    "barbara": "barb babs barbie",
    "benjamin": "ben benj benny benji",
    "catherine": "cathy kate kathy cat",
    "charles": "charlie chuck chas chaz",
    "christina": "tina chris chrissy christy",
    "christopher": "chris kit topher",
    "daniel": "dan danny",
    "david": "dave davy",
    "deborah": "deb debbie debby",
    "donald": "don donnie",
    "dorothy": "dot dolly dottie dora",
    "edward": "ed eddie ned ted teddy",
    "eleanor": "ellie nell nora nelly ella",
    "elizabeth": "liz beth betty eliza lizzie betsy bess libby",
    "frances": "fran fanny frannie francie",
    "francis": "frank fran frankie",
    "frederick": "fred fredk freddie freddy",
    "geoffrey": "geoff jeff",
    "george": "geo georgie",
    "gerald": "gerry jerry",
    "harold": "hal harry",
    "helena": "lena nell nelly helen",
    "henry": "hank harry hen hal",
    "jacqueline": "jackie jacqui",
    "james": "jim jimmy jas jamie",
    "jennifer": "jen jenny jenn",
    "john": "jack johnny jno",
    "jonathan": "jon jonny johnny",
    "joseph": "joe jos joey",
    "josephine": "jo josie",
    "judith": "judy jude",
    "katherine": "kate kathy kitty kit katie kath",
    "lawrence": "larry laurie lawrie",
    "leonard": "len leo lenny",
    "margaret": "maggie meg peggy marge margie greta",
    "matthew": "matt matty",
    "michael": "mike mick mickey",
    "mildred": "millie milly",
    "nathaniel": "nate nat nathan",
    "nicholas": "nick nicky nico",
    "pamela": "pam",
    "patricia": "pat patty trish tricia patsy",
    "penelope": "penny nell",
    "philip": "phil pip",
    "raymond": "ray",
    "rebecca": "becca becky",
    "richard": "dick rick richd rich ricky",
    "robert": "bob rob robt bobby robbie bert",
    "ronald": "ron ronnie",
    "samuel": "sam saml sammy",
    "stephen": "steve stevie steph",
    "susan": "sue suzy susie",
    "sylvester": "sly syl",
    "theodore": "theo ted teddy",
    "thomas": "tom thos tommy",
    "timothy": "tim timmy",
    "valerie": "val",
    "veronica": "vera ronnie nica",
    "victoria": "vicky tori vic",
    "vincent": "vin vince",
    "william": "will bill wm billy willy liam",
    "winifred": "winnie freda win",
}


def formal_names(table: dict[str, str] | None = None) -> dict[str, frozenset[str]]:
    """Nickname to the formal names it stands for."""
    out: dict[str, set[str]] = {}
    for formal, nicks in (NICKNAMES if table is None else table).items():
        for n in nicks.split():
            out.setdefault(n, set()).add(formal)
    return {k: frozenset(v) for k, v in out.items()}
