"""Lexers and grammars of the languages whose files are checked.

The grammars are written from the public language references.  They take the insides of brackets as units of
their own, so every rule is short; they are as wide as the language in expressions (no operator precedence)
and strict in what makes a text a text of that language: statement forms, separators, headers, brackets.
``name := item`` declares a comma list that may be empty and may end in a comma; ``name :: item`` a sequence
of items as in a block.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from arbora.llm.chart import Grammar


@dataclass
class Language:
    name: str
    token: re.Pattern[str]
    reserved: frozenset[str]
    soft: frozenset[str]
    grammar: Grammar
    lists: dict[str, str]
    blocks: dict[str, str]
    inside: dict[str, tuple[str, ...]]  # bracket -> what its inside may be, likeliest first
    top: str
    newline_ends: bool = False  # a line end may end a statement (semicolon insertion when it does not parse)
    go_on: frozenset[str] = frozenset()  # after a block, the statement goes on with these
    hold: frozenset[str] = frozenset()  # statements with semicolons in their head
    terminals: dict[str, frozenset[str]] = field(default_factory=dict)


def _build(name: str, token: str, reserved: str, soft: str, rules: str, inside: dict[str, str], top: str, **more) -> Language:
    lists: dict[str, str] = {}
    blocks: dict[str, str] = {}
    plain = []
    for line in re.sub(r"\n\s+", " ", rules.strip()).split("\n"):
        if ":=" in line and "'" not in line.split(":=")[0]:
            n, item = (x.strip() for x in line.split(":=", 1))
            lists[n] = item
            plain.append(f"{n} = | {item} ( ',' {item} )* ','?")
        elif " :: " in line:
            n, item = (x.strip() for x in line.split("::", 1))
            blocks[n] = item
            plain.append(f"{n} = {item}*")
        else:
            plain.append(line)
    return Language(name, re.compile(token), frozenset(reserved.split()), frozenset(soft.split()), Grammar("\n".join(plain)), lists, blocks,
                    {k: tuple(v.split()) for k, v in inside.items()}, top, **more)


_WORDS = r"[^\W\d][\w$]*"
_NUMBER = r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)"
_C_COMMENT = r"(?P<skip>[ \t\r\f\v]+|//[^\n]*|/\*[\s\S]*?\*/)|(?P<nl>\n)"
_DQ, _SQ = r'"(?:\\[\s\S]|[^"\\\n])*"', r"'(?:\\[\s\S]|[^'\\\n])*'"
_TEMPLATE = r"`(?:\\[\s\S]|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\}|[^`\\])*`"

# --------------------------------------------------------------------------- JavaScript and TypeScript

_JS = r"""
block :: stmt
cases :: case
classbody :: member
case = label+ | label* stmt
label = '=case' expr ':' | '=default' ':'
stmt = ';' | core | core ';'
core = simple | B:block | ifst | forst | whilest | dost | tryst | switchst | func | class | export | ID ':' stmt | decltype | '=declare' decltype | '=abstract' class
simple = estmt | var | '=return' expr? | '=throw' expr | '=break' ID? | '=continue' ID? | '=debugger' | import
import = '=import' STR | '=import' '=type'? clause '=from' STR
clause = ID | B:specs | '*' '=as' ID | ID ',' ( B:specs | '*' '=as' ID )
export = '=export' ( var | func | class | decltype | '=abstract' class | '=default' ( expr | func | class ) | '=type'? B:specs ( '=from' STR )? | '*' ( '=as' word )? '=from' STR | '=' expr )
var = ( '=const' | '=let' | '=var' ) declr ( ',' declr )*
declr = pattern '!'? ann? ( '=' expr )?
pattern = ID | B:objpat | S:arrpat
func = '=async'? '=function' '*'? ID? tparams? P:params ret? ( B:block | NOBODY )
class = deco* '=class' ID? tparams? ( '=extends' heritage )? ( '=implements' type ( ',' type )* )? B:classbody
heritage = postnb targs?
deco = '@' postnb
ifst = '=if' P:cond stmt ( '=else' stmt )?
forst = '=for' '=await'? P:forhead stmt
whilest = '=while' P:cond stmt
dost = '=do' stmt '=while' P:cond
tryst = '=try' B:block ( '=catch' P:param? B:block )? ( '=finally' B:block )?
switchst = '=switch' P:cond B:cases
cond = exprs
exprs = expr ( ',' expr )*
forhead = ( var | exprs )? ';' exprs? ';' exprs? | ( '=const' | '=let' | '=var' )? pattern ( '=of' | '=in' ) expr | postnb ( '=of' | '=in' ) expr
member = ';' | mbody ';'?
mbody = deco* mod* '*'? pname '?'? tparams? P:params ret? ( B:block | NOBODY ) | deco* mod* pname ( '?' | '!' )? ann? ( '=' expr )? | '=static' B:block | MEMTYPE
mod = '=static' | '=async' | '=get' | '=set' | '=accessor' | ACCESS
pname = word | STR | NUM | S:idx | '#' ID
word = ID | KW
params := param
param = deco* ACCESS* '...'? pattern '?'? ann? ( '=' expr )? | '=this' ann
objpat := patprop
patprop = '...' pattern | ID ( '=' expr )? | pname ':' pattern ( '=' expr )?
arrpat := patitem
patitem = | '...'? pattern ( '=' expr )?
specs := spec
spec = '=type'? ( word | STR ) ( '=as' ( word | STR ) )?
args := arg
arg = '...'? expr
arr := aitem
aitem = | '...'? expr
idx = exprs
objlit := prop
prop = '...' expr | pname ':' expr | ID ( '=' expr )? | objmod* '*'? pname tparams? P:params ret? B:block
objmod = '=async' | '=get' | '=set'
expr = operand ( binop operand )* tern? | arrow
tern = '?' expr ':' expr
binop = '+' | '-' | '*' | '**' | '/' | '%' | '<' | '>' | '<=' | '>=' | '==' | '===' | '!=' | '!==' | '&&' | '||' | '??' | '&' | '|' | '^' | '<' '<' | '>' '>' | '>' '>' '>' | '=in' | '=instanceof' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<' '<=' | '>' '>=' | '>' '>' '>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??='
operand = preop* post ( '++' | '--' )? cast* | preop* arrow
preop = '!' | '~' | '+' | '-' | '++' | '--' | '=typeof' | '=void' | '=delete' | '=await' | '=yield' '*'?
post = prim tail*
tail = '.' ( word | '#' ID ) | '?.' ( word | P:args | S:idx ) | P:args | S:idx | TPL | BANG | targs P:args
prim = primnb | B:objlit | '=function' func2 | '=async' '=function' func2 | class
func2 = '*'? ID? tparams? P:params ret? B:block
primnb = ID | NUM | STR | TPL | REGEX | '=this' | '=super' | '=null' | '=true' | '=false' | P:cond | S:arr | '=new' newexp | '=import' P:args | '=import' '.' ID | '=yield'
newexp = '.' ID | ( ID | '=this' | '=class' B:classbody | P:cond | '=new' newexp ) newtail* targs? P:args?
newtail = '.' ( word | '#' ID ) | S:idx
arrow = '=async'? ( ID | tparams? P:params ret? ) '=>' ( B:block | expr )
postnb = primnb tail*
fnblock = ( '=export' '=default'? )? func ';'?
fnclass = deco* mod* '*'? pname '?'? tparams? P:params ret? B:block ';'?
estmt = ( preop+ post ( '++' | '--' )? cast* | postnb ( '++' | '--' )? cast* ) ( binop operand )* tern? ( ',' expr )* | arrow
"""
_JS_ONLY = r"""
decltype = NEVER
ann = NEVER
ret = NEVER
tparams = NEVER
targs = NEVER
type = NEVER
cast = NEVER
"""
_TS_ONLY = r"""
decltype = '=interface' ID tparams? ( '=extends' type ( ',' type )* )? B:membs | '=type' ID tparams? '=' type | '=const'? '=enum' ID B:enumb | ( '=namespace' | '=module' ) ( ID ( '.' ID )* | STR ) B:block | '=declare' ( var | func | class | decltype | '=abstract' class | '=global' B:block )
ann = ':' type
ret = ':' ( '=asserts'? ( ID | '=this' ) '=is' type | type )
tparams = '<' tparam ( ',' tparam )* ','? '>'
tparam = '=const'? ID ( '=extends' type )? ( '=' type )?
targs = '<' type ( ',' type )* '>'
cast = '=as' ( type | '=const' ) | '=satisfies' type
type = utype ( '=extends' utype '?' type ':' type )?
utype = '|'? itype ( ( '|' | '&' ) itype )*
itype = ( '=keyof' | '=readonly' | '=unique' | '=infer' )* ptype ( S:empty | S:type )*
ptype = ID ( '.' ID )* targs? | STR | NUM | '-' NUM | TPL | '=null' | '=void' | '=this' | '=true' | '=false' | '=typeof' ID ( '.' word )* | B:membs | S:types | P:type | tparams? P:params '=>' ret2 | '=new' P:params '=>' type | '=import' P:args ( '.' ID )*
ret2 = ID '=is' type | type
types := tuple
tuple = '...'? ( ID '?'? ':' )? type '?'?
membs :: memb
memb = mcore ( ';' | ',' )? | ';'
mcore = ( '=readonly' | '=get' | '=set' | '-' | '+' )* pname '?'? tparams? ( P:params )? ann? | tparams? P:params ann? | '=new' P:params ann? | ( '-' | '+' )? '=readonly'? S:mapped ( '?' | '-' '?' | '+' '?' )? ann
mapped = ID '=in' type ( '=as' type )? | ID ann
enumb := enumi
enumi = ( ID | STR ) ( '=' expr )?
empty =
"""
_JS_TOKEN = (_C_COMMENT + r"|(?P<str>" + _DQ + "|" + _SQ + r")|(?P<tpl>" + _TEMPLATE + r")|(?P<num>" + _NUMBER + r"n?(?![\w$]))|(?P<word>[^\W\d]\w*(?:\$[\w$]*)*|\$[\w$]*)"
             r"|(?P<op>\.\.\.|=>|===|!==|\*\*=|&&=|\|\|=|\?\?=|\*\*|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|[-+*/%&|^]=|[-+*/%&|^!~<>=?:;,.@#])"
             r"|(?P<open>[({\[])|(?P<close>[)}\]])|(?P<bad>[\s\S])")
_JS_RESERVED = ("break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof "
                "new null return super switch this throw true try typeof var void while with yield enum")
_JS_SOFT = "let static await async of get set from as accessor"
_TS_SOFT = _JS_SOFT + " type interface namespace module declare abstract readonly implements public private protected override keyof infer is asserts unique satisfies global"


def _javascript() -> Language:
    rules = _JS.replace("NOBODY", "NEVER").replace("MEMTYPE", "NEVER").replace("ACCESS", "NEVER").replace("BANG", "NEVER").replace("'=implements' type ( ',' type )*", "NEVER")
    return _build("javascript", _JS_TOKEN, _JS_RESERVED, _JS_SOFT, _quoted(rules.strip() + chr(10) + _JS_ONLY.strip()),
                  {"P": "args params cond forhead param", "S": "arr idx arrpat", "B": "block objlit classbody objpat specs cases"}, "block",
                  newline_ends=True, go_on=_JS_GO_ON)


def _typescript() -> Language:
    access = "( '=public' | '=private' | '=protected' | '=readonly' | '=abstract' | '=override' | '=declare' )"
    rules = _JS.replace("| NOBODY", "|").replace("MEMTYPE", "mod* S:mapped ann").replace("ACCESS", access).replace("BANG", "'!'")
    return _build("typescript", _JS_TOKEN, _JS_RESERVED, _TS_SOFT, _quoted(rules.strip() + chr(10) + _TS_ONLY.strip()),
                  {"P": "args params cond forhead param type", "S": "arr idx arrpat empty type types mapped", "B": "block objlit classbody objpat specs cases membs enumb"}, "block",
                  newline_ends=True, go_on=_JS_GO_ON)


_JS_GO_ON = frozenset("=else =catch =finally =while =from =as =of =in =instanceof , ) . ; ? : => = + - * / % < > == === != !== && || ?? & | ^ ?. P S B".split())

# --------------------------------------------------------------------------- Java

_JAVA = r"""
unit :: decl
decl = ann* '=package' qname ';' | '=import' '=static'? qname ( '.' '*' )? ';' | typedecl ';'? | ';' | member
typedecl = mod* ( class | iface | enum | record | annot )
class = '=class' ID tparams? ( '=extends' type )? ( '=implements' types )? ( '=permits' types )? B:classbody
iface = '=interface' ID tparams? ( '=extends' types )? ( '=permits' types )? B:classbody
annot = '@' '=interface' ID B:classbody
enum = '=enum' ID ( '=implements' types )? B:enumbody
record = '=record' ID tparams? P:params ( '=implements' types )? B:classbody
mod = '=public' | '=private' | '=protected' | '=static' | '=final' | '=abstract' | '=native' | '=synchronized' | '=transient' | '=volatile' | '=strictfp' | '=default' | '=sealed' | '=non' '-' '=sealed' | ann
ann = '@' qname P:annargs?
annargs := annarg
annarg = ( ID '=' )? ( expr | ann | B:arrinit )
qname = ID ( '.' ID )*
classbody :: member
member = ';' | typedecl | mod* tparams? ( type | '=void' ) ID P:params dims* throws? ( B:block | ';' | '=default' ( expr | B:arrinit ) ';' ) | mod* type declr ( ',' declr )* ';' | mod* tparams? ID P:params throws? B:block | mod* ID B:block | '=static'? B:block
fnclass = mod* tparams? ( type | '=void' ) ID P:params dims* throws? ( B:block | ';' ) | mod* tparams? ID P:params throws? B:block
throws = '=throws' types
types = type ( ',' type )*
enumbody = ( econst ( ',' econst )* ','? )? ( ';' member* )?
econst = ann* ID P:args? B:classbody?
declr = ID dims* ( '=' ( expr | B:arrinit ) )?
dims = S:empty
empty =
type = ann* base ( '.' base )* dims*
base = ( ID | PRIM ) targs?
targs = '<' ( targ ( ',' targ )* )? '>'
targ = type | '?' ( ( '=extends' | '=super' ) type )?
tparams = '<' tparam ( ',' tparam )* '>'
tparam = ID ( '=extends' type ( '&' type )* )?
params := param
param = mod* type '...'? ( ID dims* | '=this' )
names := lname
lname = ID
block :: stmt
stmt = ';' | B:block | local ';' | estmt ';' | typedecl | '=if' P:cond stmt ( '=else' stmt )? | '=for' P:forhead stmt | '=while' P:cond stmt | '=do' stmt '=while' P:cond ';' | '=try' P:res? B:block ( '=catch' P:catchp B:block )* ( '=finally' B:block )? | '=switch' P:cond B:cases | '=return' expr? ';' | '=throw' expr ';' | '=break' ID? ';' | '=continue' ID? ';' | '=synchronized' P:cond B:block | '=assert' expr ( ':' expr )? ';' | ID ':' stmt | '=yield' expr ';' | ( '=this' | '=super' ) P:args ';'
local = mod* type declr ( ',' declr )*
cond = expr
forhead = ( local | exprs )? ';' expr? ';' exprs? | mod* type ID ':' expr
exprs = expr ( ',' expr )*
res = resi ( ';' resi )* ';'?
resi = mod* type ID '=' expr | expr
catchp = mod* type ( '|' type )* ID
cases :: caseb
caseb = lab+ | lab* stmt | ( '=case' label ( ',' label )* ( '=when' expr )? | '=default' ) '->' ( stmt | expr ';' )
lab = '=case' label ( ',' label )* ( '=when' expr )? ':' | '=default' ':'
label = expr | type ID | '=default'
args := expr
arrinit := arri
arri = expr | B:arrinit
estmt = expr
expr = operand ( binop operand | '=instanceof' '=final'? type ID? )* ( '?' expr ':' expr )? | lambda
lambda = ( ID | P:params | P:names ) '->' ( expr | B:block )
binop = '+' | '-' | '*' | '/' | '%' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&&' | '||' | '&' | '|' | '^' | '<' '<' | '>' '>' | '>' '>' '>' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<' '<=' | '>' '>=' | '>' '>' '>='
operand = pre* post ( '++' | '--' )? | pre* lambda
pre = '+' | '-' | '!' | '~' | '++' | '--' | P:castt
castt = type ( '&' type )*
post = prim tail*
tail = '.' ( ID | '=this' | '=super' | '=class' | '=new' type P:args B:classbody? | targs ID ) | P:args | S:idx | '::' ( ID | '=new' )
idx = expr
prim = ID | NUM | STR | '=this' | '=super' | '=null' | '=true' | '=false' | P:cond | '=new' newe | type '::' ( ID | '=new' ) | PRIM dims* '.' '=class' | ID dims '.' '=class' | '=switch' P:cond B:cases
newe = type P:args B:classbody? | base ( '.' base )* S:idx+ dims* | type B:arrinit
"""
_JAVA_RESERVED = ("abstract assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof interface "
                  "native new package private protected public return static strictfp super switch synchronized this throw throws transient try void volatile while true false null")
_PRIM_JAVA = "boolean byte char short int long float double"


def _java() -> Language:
    token = (_C_COMMENT + r'|(?P<str>"""[\s\S]*?"""|' + _DQ + r"|'(?:\\[^\n]{1,6}?|[^'\\\n]|[^'\\\n]{2})')|(?P<num>" + _NUMBER + r"[lLfFdD]?(?!\w))|(?P<word>" + _WORDS + r")"
             r"|(?P<op>\.\.\.|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|[-+*/%&|^]=|[-+*/%&|^!~<>=?:;,.@])|(?P<open>[({\[])|(?P<close>[)}\]])|(?P<bad>[\s\S])")
    lang = _build("java", token, _JAVA_RESERVED, "record sealed permits when yield non", _quoted(_JAVA),
                  {"P": "args params cond forhead castt names res catchp annargs", "S": "idx empty", "B": "block classbody arrinit cases enumbody"}, "unit",
                  go_on=frozenset("=else =catch =finally =while =instanceof , ) . ; ? : :: = + - * / % < > == != && || & | ^ P S B".split()))
    lang.terminals |= {w: frozenset(("PRIM",)) for w in _PRIM_JAVA.split()}
    return lang


# --------------------------------------------------------------------------- C#

_CS = r"""
unit :: decl
decl = '=extern' ID ID ';' | '=global'? '=using' '=static'? ( ID '=' )? type ';' | '=namespace' qname ( B:unit ';'? | ';' ) | attr+ | typedecl ';'? | ';' | member | stmt
attr = S:any
any = NEVER
typedecl = attr* mod* ( class | enum | deleg )
class = ( '=class' | '=struct' | '=interface' | '=record' ( '=class' | '=struct' )? ) ID tparams? P:params? ( ':' type P:args? ( ',' type )* )? where* ( B:classbody | ';' )
enum = '=enum' ID ( ':' type )? B:enumb
enumb := enumi
enumi = attr* ID ( '=' expr )?
deleg = '=delegate' type ID tparams? P:params where* ';'
where = '=where' ID ':' cons ( ',' cons )*
cons = type | '=class' '?'? | '=struct' | '=new' P:args | '=notnull' | '=unmanaged'
mod = '=public' | '=private' | '=protected' | '=internal' | '=static' | '=readonly' | '=sealed' | '=abstract' | '=virtual' | '=override' | '=async' | '=const' | '=extern' | '=unsafe' | '=volatile' | '=partial' | '=new' | '=required' | '=file'
qname = ID ( ( '.' | '::' ) ID )*
classbody :: member
member = ';' | typedecl | attr* mod* type mname tparams? P:params where* ( B:block | '=>' expr ';' | ';' ) | attr* mod* type declr ( ',' declr )* ';' | attr* mod* type mname ( B:accs ( '=' expr ';' )? | '=>' expr ';' ) | attr* mod* '~'? ID P:params ( ':' ( '=base' | '=this' ) P:args )? ( B:block | '=>' expr ';' | ';' ) | attr* mod* '=event' type ID ( ',' ID )* ( B:accs | ';' ) | attr* mod* type '=this' S:params ( B:accs | '=>' expr ';' ) | attr* mod* ( type '=operator' opname | ( '=implicit' | '=explicit' ) '=operator' type ) P:params ( B:block | '=>' expr ';' )
fnclass = attr* mod* type mname tparams? P:params where* ( B:block | '=>' expr ';' | ';' ) | attr* mod* ID P:params ( ':' ( '=base' | '=this' ) P:args )? ( B:block | '=>' expr ';' )
mname = ID targs? ( '.' ID targs? )*
opname = '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '!' | '~' | '++' | '--' | '&' | '|' | '^' | '=true' | '=false'
accs :: acc
acc = attr* mod* ( '=get' | '=set' | '=init' | '=add' | '=remove' ) ( ';' | B:block | '=>' expr ';' )
declr = ID ( '=' ( expr | B:init ) )?
type = tcore tsuf*
tcore = tb ( ( '.' | '::' ) tb )* | '=ref' '=readonly'? type | P:ttuple
tb = ( ID | PRIM ) targs?
tsuf = '?' | S:commas | '*'
commas = ','*
ttuple = titem ( ',' titem )+
titem = type ID?
targs = '<' ( type ( ',' type )* | ','* ) '>'
tparams = '<' tparam ( ',' tparam )* '>'
tparam = attr* ( '=in' | '=out' )? ID
params := param
param = attr* ( '=this' | '=ref' | '=out' | '=in' | '=params' | '=scoped' )* type ID ( '=' expr )?
names := lname
lname = ( '=ref' | '=out' )? ID
block :: stmt
stmt = ';' | B:block | local ';' | estmt ';' | '=if' P:cond stmt ( '=else' stmt )? | '=for' P:forhead stmt | '=await'? '=foreach' P:forhead stmt | '=while' P:cond stmt | '=do' stmt '=while' P:cond ';' | '=try' B:block ( '=catch' P:catchp? ( '=when' P:cond )? B:block )* ( '=finally' B:block )? | '=switch' P:cond B:cases | '=return' expr? ';' | '=throw' expr? ';' | '=break' ';' | '=continue' ';' | '=goto' ( ID | '=case' expr | '=default' ) ';' | '=lock' P:cond stmt | '=await'? '=using' P:forhead stmt | '=await'? '=using' local ';' | '=yield' ( '=return' expr | '=break' ) ';' | ( '=checked' | '=unchecked' | '=unsafe' ) B:block | ID ':' stmt | mod* type ID tparams? P:params where* ( B:block | '=>' expr ';' )
local = ( '=const' | '=ref' | '=static' )* type declr ( ',' declr )*
cond = expr
forhead = ( local | exprs )? ';' expr? ';' exprs? | type ( ID | P:names ) '=in' expr | local | expr
exprs = expr ( ',' expr )*
catchp = type ID?
cases :: caseb
caseb = lab+ | lab* stmt
lab = '=case' pat ( '=when' expr )? ':' | '=default' ':'
pat = '=not'? patom ( ( '=and' | '=or' ) '=not'? patom )*
patom = expr | type ID | B:props ID? | type B:props ID? | ( '<' | '>' | '<=' | '>=' ) expr | P:pat
props := propp
propp = ID ( '.' ID )* ':' pat
args := arg
arg = ( ID ':' )? ( '=ref' | '=out' | '=in' )? ( expr | type ID )
init := initi
initi = expr | B:init | ( ID | S:idx ) '=' ( expr | B:init )
arms := arm
arm = pat ( '=when' expr )? '=>' expr
estmt = expr
expr = operand ( binop operand | '=is' pat | '=as' type | '=switch' B:arms | '=with' B:init )* ( '?' expr ':' expr )? | lambda | '=throw' expr
lambda = ( '=async' | '=static' )* ( ID | P:params | P:names ) '=>' ( expr | B:block ) | '=async'? '=delegate' P:params? B:block
binop = '+' | '-' | '*' | '/' | '%' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&&' | '||' | '??' | '&' | '|' | '^' | '<' '<' | '>' '>' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '??=' | '<' '<=' | '>' '>=' | '..'
operand = pre* post ( '++' | '--' )? | pre* lambda
pre = '+' | '-' | '!' | '~' | '++' | '--' | '&' | '*' | '^' | '=await' | '=ref' | P:castt
castt = type
post = prim tail*
tail = '.' ID targs? | '?' '.' ID targs? | '?' S:args | '->' ID | P:args | S:args | '!'
idx = expr
prim = ID targs? | ID '::' ID | NUM | STR | PRIM | '=this' | '=base' | '=null' | '=true' | '=false' | '=default' P:castt? | P:cond | P:tuple | '=new' newe | ( '=typeof' | '=sizeof' | '=nameof' ) P:any2 | ( '=checked' | '=unchecked' ) P:cond | S:init | '=stackalloc' type
any2 = type | expr
tuple = arg ( ',' arg )+
newe = type P:args B:init? | type B:init | tb ( '.' tb )* S:args S:commas* B:init? | S:commas B:init | P:args B:init? | B:init
"""
_CS_RESERVED = ("abstract as base break case catch checked class const continue default delegate do else enum event explicit extern false finally fixed for foreach goto if implicit in "
                "interface internal is lock namespace new null operator out override params private protected public readonly ref return sealed sizeof stackalloc static struct switch "
                "this throw true try typeof unchecked unsafe using virtual volatile while")
_CS_SOFT = "async await get set init add remove partial where record required file global when yield nameof not and or with notnull unmanaged scoped"
_PRIM_CS = "bool byte sbyte char decimal double float int uint long ulong short ushort string object void dynamic nint nuint"


def _csharp() -> Language:
    token = (r"(?P<skip>[ \t\r\f\v]+|//[^\n]*|/\*[\s\S]*?\*/|(?<![^\n])[ \t]*\#[^\n]*)|(?P<nl>\n)"
             r'|(?P<str>\$*"""[\s\S]*?"""|(?:\$@|@\$|@)"(?:""|[^"])*"|\$?' + _DQ + r"|'(?:\\[^\n]{1,8}?|[^'\\\n])')|(?P<num>" + _NUMBER + r"[uUlLfFdDmM]*(?!\w))|(?P<word>@?" + _WORDS + r")"
             r"|(?P<op>=>|->|::|\.\.|\?\?=|\?\?|==|!=|<=|>=|&&|\|\||\+\+|--|[-+*/%&|^]=|[-+*/%&|^!~<>=?:;,.])|(?P<open>[({\[])|(?P<close>[)}\]])|(?P<bad>[\s\S])")
    lang = _build("csharp", token, _CS_RESERVED, _CS_SOFT, _quoted(_CS),
                  {"P": "args params cond forhead castt names catchp tuple ttuple any2 pat", "S": "args commas any params init", "B": "block classbody init accs cases unit enumb arms props"}, "unit",
                  go_on=frozenset("=else =catch =finally =while =is =as =switch =with , ) . ; ? : = => + - * / % < > == != && || ?? & | ^ P S B".split()))
    lang.terminals |= {w: frozenset(("PRIM",)) for w in _PRIM_CS.split()}
    return lang


# --------------------------------------------------------------------------- Go

_GO = r"""
unit :: decl
decl = top ';'? | ';'
top = '=package' ID | '=import' ( impspec | P:impspecs ) | '=func' P:params? ID S:tparams? P:params result? B:block? | vard
vard = '=type' ( typespec | P:typespecs ) | ( '=var' | '=const' ) ( varspec | P:varspecs )
fnblock = '=func' P:params? ID S:tparams? P:params result? B:block ';'?
impspec = ( ID | '.' )? STR
impspecs = ( impspec ( ';' impspec )* ';'? )?
typespec = ID S:tparams? '='? type
typespecs = ( typespec ( ';' typespec )* ';'? )?
varspec = ID ( ',' ID )* type? ( '=' exprs )?
varspecs = ( varspec ( ';' varspec )* ';'? )?
result = type | P:params
params := param
param = ID? '...'? type
tparams := tpar
tpar = ID? '~'? type ( '|' '~'? type )*
type = ID ( '.' ID )? S:types? | '*' type | S:empty type | S:len type | '=map' S:types type | '=chan' '<-'? type | '<-' '=chan' type | '=func' P:params result? | '=struct' B:fields | '=interface' B:methods | P:types
types := type
empty =
len = expr | '...'
fields = ( fieldd ( ';' fieldd )* ';'? )?
fieldd = ( ID ( ',' ID )* type | '*'? ID ( '.' ID )? S:types? ) STR?
methods = ( methd ( ';' methd )* ';'? )?
methd = ID P:params result? | '~'? type ( '|' '~'? type )*
block :: stmt
cases :: caseb
caseb = lab+ ';'? | lab* stmt
lab = '=case' ( exprs | types2 | simple ) ':' | '=default' ':'
types2 = type ( ',' type )*
stmt = ';' | core | core ';'
core = simple | vard | '=go' expr | '=defer' expr | '=return' exprs? | ( '=break' | '=continue' | '=goto' ) ID? | '=fallthrough' | ifst | forst | switchst | '=select' B:cases | B:block | ID ':' stmt
simple = exprs | exprs asg exprs | expr ( '++' | '--' ) | expr '<-' expr
asg = '=' | ':=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
ifst = '=if' ( simple? ';' )? expr B:block ( '=else' ( ifst | B:block ) )?
forst = '=for' ( expr? | simple? ';' expr? ';' simple? | ( exprs ( ':=' | '=' ) )? '=range' expr ) B:block
switchst = '=switch' ( simple? ';' )? ( expr | ID ':=' expr )? B:cases
exprs = expr ( ',' expr )*
expr = operand ( binop operand )*
binop = '+' | '-' | '*' | '/' | '%' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>>' | '&^'
operand = pre* prim tail*
pre = '+' | '-' | '!' | '^' | '*' | '&' | '<-'
prim = ID | NUM | STR | P:par | '=func' P:params result? B:block | littype B:complit | S:empty type | '=map' S:types type | '=chan' type | '=struct' B:fields | '=interface' B:methods
littype = ID ( '.' ID )? S:types? | S:empty type | S:len type | '=map' S:types type | '=struct' B:fields
par = expr | type
tail = '.' ( ID | P:assertt ) | P:args | S:idx
assertt = type | '=type'
args = ( arg ( ',' arg )* '...'? ','? )?
arg = expr | type
idx = expr | expr? ':' expr? ( ':' expr )? | types2
complit := elem
elem = ( ( expr | B:complit ) ':' )? ( expr | B:complit )
"""
_GO_RESERVED = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"


def _go() -> Language:
    token = (_C_COMMENT + r"|(?P<str>" + _DQ + r"|`[^`]*`|'(?:\\[^\n]{1,10}?|[^'\\\n])')|(?P<num>" + _NUMBER + r"i?(?!\w))|(?P<word>[^\W\d]\w*)"
             r"|(?P<op>\.\.\.|<<=|>>=|&\^=|:=|<-|<<|>>|&\^|==|!=|<=|>=|&&|\|\||\+\+|--|[-+*/%&|^]=|[-+*/%&|^!~<>=:;,.])|(?P<open>[({\[])|(?P<close>[)}\]])|(?P<bad>[\s\S])")
    return _build("go", token, _GO_RESERVED, "", _quoted(_GO),
                  {"P": "args params par types assertt impspecs varspecs typespecs", "S": "idx empty len types tparams", "B": "block complit fields methods cases"}, "unit",
                  hold=frozenset(("=if", "=for", "=switch")), go_on=frozenset("=else , ) . ; : = := + - * / % < > == != && || & | ^ P S B".split()))


# --------------------------------------------------------------------------- Rust

_RUST = r"""
unit :: decl
decl = item | ';' | attr
attr = '#' '!'? S:any
any = NEVER
item = attr* vis? ( use | mod | fn | struct | enum | union | impl | trait | const | tyalias | extern | macro )
vis = '=pub' P:any?
use = '=use' '::'? usetree ';'
usetree = useseg ( '::' useseg )* ( '::' ( '*' | B:uses ) )? ( '=as' ID )? | '*' | B:uses
useseg = ID | '=crate' | '=self' | '=super'
uses := usei
usei = usetree
mod = '=unsafe'? '=mod' ID ( ';' | B:unit )
fn = ( '=const' | '=async' | '=unsafe' | '=extern' STR? | '=default' )* '=fn' ID gpar? P:params ( '->' type )? where? ( B:block | ';' )
fnblock = attr* vis? fn
struct = '=struct' ID gpar? ( where? B:fields | P:tfields where? ';' | ';' )
union = '=union' ID gpar? B:fields
enum = '=enum' ID gpar? where? B:variants
impl = '=unsafe'? '=impl' gpar? '!'? type ( '=for' type )? where? B:assoc
trait = '=unsafe'? '=auto'? '=trait' ID gpar? ( ':' bounds? )? where? B:assoc
const = ( '=const' | '=static' '=mut'? ) ID ':' type ( '=' expr )? ';'
tyalias = '=type' ID gpar? ( ':' bounds )? where? ( '=' type )? ';'
extern = '=extern' '=crate' ID ( '=as' ID )? ';' | '=unsafe'? '=extern' STR? B:assoc
macro = path '!' ID? ( B:any | ( P:any | S:any ) ';' )
assoc :: associ
associ = item | attr
gpar = '<' ( gp ( ',' gp )* ','? )? '>'
gp = attr* ( LIFE ( ':' LIFE ( '+' LIFE )* )? | ID ( ':' bounds? )? ( '=' type )? | '=const' ID ':' type ( '=' expr )? )
where = '=where' ( wp ( ',' wp )* ','? )?
wp = type ':' bounds | LIFE ':' LIFE | '=for' gpar type ':' bounds
bounds = bound ( '+' bound )*
bound = '?'? type | LIFE | P:type | '=for' gpar type
params := param
param = attr* ( '&' LIFE? '=mut'? '=self' | '=mut'? '=self' ( ':' type )? | pat ':' type | '...' )
fields := fieldd
fieldd = attr* vis? ID ':' type
tfields := tfield
tfield = attr* vis? type
variants := variant
variant = attr* vis? ID ( B:fields | P:tfields )? ( '=' expr )?
type = '&' LIFE? '=mut'? type | '&&' LIFE? '=mut'? type | '*' ( '=const' | '=mut' ) type | tpath | P:types | S:arrt | ( '=dyn' | '=impl' ) bounds | ( '=unsafe' | '=extern' STR? )* '=fn' P:fnargs ( '->' type )? | '!' | '_' | '=for' gpar type | path '!' ( P:any | S:any | B:any )
fnargs := fnarg
fnarg = ( ID ':' | '_' ':' )? type
types := type
arrt = type ( ';' expr )?
tpath = '::'? tseg ( '::' tseg )* | qself ( '::' tseg )+
qself = '<' type ( '=as' type )? '>'
tseg = seg ( '::'? targs | P:types ( '->' type )? )?
seg = ID | '=crate' | '=self' | '=super' | '=Self'
targs = '<' ( targ ( ',' targ )* ','? )? '>'
targ = type | LIFE | NUM | STR | B:block | ID '=' type | ID ':' bounds | '-' NUM | '=true' | '=false'
path = '::'? pseg ( '::' pseg )* | qself ( '::' pseg )+
pseg = seg ( '::' targs )?
block :: stmt
stmt = ';' | attr* let | item | attr* expr ';' | attr* blocky ';'? | attr* expr END | attr+ END
let = '=let' pat ( ':' type )? ( '=' expr ( '=else' B:block )? )? ';'
pat = '|'? pat1 ( '|' pat1 )*
pat1 = ( '&' | '&&' | '=ref' | '=mut' | '=box' )* patc ( '@' pat1 )? | '..' | lit? ( '..=' | '..' | '...' ) lit?
patc = path ( P:pats | B:patf )? | lit | P:pats | S:pats | '_' | path '!' P:any | '=const' B:block
lit = '-'? NUM | STR | '=true' | '=false' | path
pats := pat
patf := patfi
patfi = attr* ( '=ref' | '=mut' )* ( ID | NUM ) ( ':' pat )? | '..'
expr = operand ( binop operand | '=as' type )* | range
range = operand? ( '..' | '..=' ) operand?
binop = '+' | '-' | '*' | '/' | '%' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&&' | '||' | '&' | '|' | '^' | '<' '<' | '>' '>' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<' '<=' | '>' '>=' | '..' | '..='
operand = pre* prim tail*
pre = '&' | '&&' | '=mut' | '*' | '!' | '-' | '=raw' '=const'
tail = '.' ( ID ( '::' targs )? | NUM | '=await' ) | P:args | S:idx | '?'
idx = expr
args := expr
prim = NUM | STR | '=true' | '=false' | path | path B:slit | path '!' ( P:any | S:any | B:any ) | P:args | S:arr | blocky | closure | '=return' expr? | '=break' LIFE? expr? | '=continue' LIFE? | '=yield' expr?
arr = ( expr ( ',' expr )* ','? | expr ';' expr )?
slit := sliti
sliti = attr* ( ID | NUM ) ( ':' expr )? | '..' expr?
blocky = ( LIFE ':' )? ( B:block | ( '=unsafe' | '=const' | '=async' '=move'? ) B:block | ifx | '=match' expr B:arms | '=loop' B:block | '=while' conds B:block | '=for' pat '=in' expr B:block )
ifx = '=if' conds B:block ( '=else' ( ifx | B:block ) )?
conds = cnd ( '&&' cnd )*
cnd = expr | '=let' pat '=' expr
arms = ( arm* lastarm )?
arm = attr* pat ( '=if' conds )? '=>' ( expr ',' | blocky ','? )
lastarm = attr* pat ( '=if' conds )? '=>' expr ','?
closure = '=static'? '=async'? '=move'? ( '||' | '|' ( cpar ( ',' cpar )* ','? )? '|' ) ( '->' type B:block | expr )
cpar = attr* pat1 ( ':' type )?
"""
_RUST_RESERVED = "as break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await _"


def _rust() -> Language:
    token = (_C_COMMENT + r'|(?P<str>b?c?r(?P<h>\#*)"[\s\S]*?"(?P=h)|[bc]?"(?:\\[\s\S]|[^"\\])*"|b?\'(?:\\[^\n]{1,10}?|[^\'\\\n])\')|(?P<life>\'[A-Za-z_]\w*)|(?P<num>'
             r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?\d+)?)(?:_?[iuf](?:8|16|32|64|128|size))?(?!\w))|(?P<word>(?:r\#)?[^\W\d]\w*)"
             r"|(?P<op>\.\.\.|\.\.=|\.\.|=>|->|::|==|!=|<=|>=|&&|\|\||[-+*/%&|^]=|[-+*/%&|^!~<>=?:;,.@#$])|(?P<open>[({\[])|(?P<close>[)}\]])|(?P<bad>[\s\S])")
    return _build("rust", token, _RUST_RESERVED, "union default auto box raw yield macro_rules", _quoted(_RUST),
                  {"P": "args params types pats tfields fnargs type any", "S": "idx arr arrt pats any", "B": "block fields assoc variants arms slit uses unit patf any"}, "unit",
                  go_on=frozenset("=else =as , ) . ; ? = => + * / % < > == != && || | ^ :: ".split()))


def _quoted(rules: str) -> str:
    """'=word' in the rules above is the keyword ``word``; the notation quotes it as a plain token."""
    return re.sub(r"'=(\w+)'", r"'\1'", rules)


# --------------------------------------------------------------------------- Python

_PY = r"""
line = simple ( ';' simple )* ';'? | head ( simple ( ';' simple )* ';'? )?
head = '=async'? ( for | with | def ) | class | '=if' named ':' | '=elif' named ':' | '=else' ':' | '=while' named ':' | '=try' ':' | '=except' '*'? ( exprs ( '=as' ID )? )? ':' | '=finally' ':' | '=match' exprs ':' | '=case' patterns ( '=if' named )? ':'
fnblock = '=async'? def
for = '=for' targets '=in' exprs ':'
with = '=with' ( withi ( ',' withi )* | P:withs ) ':'
withi = test ( '=as' target )?
withs := withi
def = '=def' ID S:tpars? P:params ( '->' exprs )? ':'
class = '=class' ID S:tpars? P:args? ':'
tpars := tpar
tpar = ( '*' | '**' )? ID ( ':' test )? ( '=' test )?
params := param
param = ID ( ':' test )? ( '=' test )? | '*' ( ID ( ':' ( test | '*' test ) )? )? | '**' ID ( ':' test )? | '/'
simple = exprs ( '=' rhs )* | exprs ':' test ( '=' rhs )? | exprs aug rhs | '=pass' | '=break' | '=continue' | '=return' rhs? | '=raise' ( test ( '=from' test )? )? | '=global' names | '=nonlocal' names | '=del' exprs | '=assert' test ( ',' test )? | '=import' dotted2 ( ',' dotted2 )* | '=from' ( '.' | '...' )* dotted? '=import' ( '*' | imps | P:imports ) | yield | '=type' ID S:tpars? '=' test | '@' named
aug = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '**=' | '@=' | '&=' | '|=' | '^=' | '<<=' | '>>='
rhs = exprs | yield
yield = '=yield' ( '=from' test | exprs )?
names = ID ( ',' ID )*
dotted = ID ( '.' ID )*
dotted2 = dotted ( '=as' ID )?
imps = imp ( ',' imp )*
imports = imp ( ',' imp )* ','?
imp = ID ( '=as' ID )?
exprs = starred ( ',' starred )* ','?
starred = '*' test | named
named = ( ID ':=' )? test
targets = target ( ',' target )* ','?
target = '*'? post
test = or ( '=if' or '=else' test )? | '=lambda' lparams ':' test
lparams = ( lparam ( ',' lparam )* ','? )?
lparam = ID ( '=' test )? | '*' ID? | '**' ID | '/'
or = unary ( binop unary )*
binop = '+' | '-' | '*' | '/' | '//' | '%' | '**' | '@' | '&' | '|' | '^' | '<<' | '>>' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '=and' | '=or' | '=in' | '=not' '=in' | '=is' | '=is' '=not'
unary = ( '+' | '-' | '~' | '=not' )* '=await'? post
post = atom trailer*
trailer = '.' ID | P:args | S:sub
atom = ID | NUM | STR+ | '=None' | '=True' | '=False' | '...' | P:tuple | S:list | B:dict
tuple := starred
tuple = yield | starred comp
list := starred
list = starred comp
comp = '=async'? '=for' targets '=in' or ( '=if' or2 )* comp?
or2 = or | named
args := arg
args = named comp
arg = named | ID '=' test | '*' test | '**' test
sub := slice
slice = starred | test? ':' test? ( ':' test? )?
dict := ditem
dict = test ':' test comp | starred comp
ditem = test ':' test | '**' or | starred
patterns = pattern ( ',' pattern )* ','?
pattern = pat1 ( '|' pat1 )* ( '=as' ID )? | '*' ID
pat1 = '-'? NUM ( ( '+' | '-' ) NUM )? | STR+ | '=None' | '=True' | '=False' | ID ( '.' ID )* P:pargs? | P:patgroup | S:patgroup | B:pdict
pargs := parg
parg = ( ID '=' )? pattern
patgroup := pattern
pdict := pditem
pditem = ( '-'? NUM | STR+ | ID ( '.' ID )* | '=None' | '=True' | '=False' ) ':' pattern | '**' ID
"""
_PY_RESERVED = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"


def _python() -> Language:
    prefix = r"(?:[rRuUbBfFtT]|[rR][bBfF]|[bBfF][rR])?"
    token = (r"(?P<skip>[ \t\r\f]+|\#[^\n]*|\\\r?\n)|(?P<nl>\n)|(?P<str>" + prefix + r'(?:"""(?:\\[\s\S]|[^\\])*?"""|\'\'\'(?:\\[\s\S]|[^\\])*?\'\'\'|(?!"""|\'\'\')(?:' + _DQ + "|" + _SQ + r")))"
             r"|(?P<num>" + _NUMBER + r"[jJ]?(?!\w))|(?P<word>[^\W\d]\w*)|(?P<op>\.\.\.|\*\*=|//=|<<=|>>=|:=|->|\*\*|//|<<|>>|==|!=|<=|>=|[-+*/%&|^@]=|[-+*/%&|^~<>=:;,.@])"
             r"|(?P<open>[({\[])|(?P<close>[)}\]])|(?P<bad>[\s\S])")
    return _build("python", token, _PY_RESERVED, "match case type", _quoted(_PY),
                  {"P": "args params tuple imports withs pargs patgroup", "S": "sub list tpars patgroup", "B": "dict pdict"}, "line")


_MAKERS = {"javascript": _javascript, "typescript": _typescript, "java": _java, "csharp": _csharp, "go": _go, "rust": _rust, "python": _python}
_MADE: dict[str, Language] = {}
#: What a file name's ending stands for.
EXTENSIONS = {"py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript",
              "cts": "typescript", "java": "java", "cs": "csharp", "go": "go", "rs": "rust"}


def language(name: str) -> Language:
    if name not in _MADE:
        _MADE[name] = _MAKERS[name]()
    return _MADE[name]


def language_of(path: str) -> str | None:
    return EXTENSIONS.get(path.rsplit(".", 1)[-1].lower()) if "." in path.rsplit("/", 1)[-1] else None
