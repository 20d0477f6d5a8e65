"""Parsing-expression grammars of seven languages, over the tokens of ``lexers``.

They are written from the public language references. Where a language needs to know whether a brace can open a literal
(conditions of Go and Rust), the expression rules exist twice. What is not checked: names and types, and early errors
that are about meaning (a jump without a target, say).
"""

from quarryline.llm import lexers
from quarryline.llm.peg import Parser

GO = r"""
File <- 'package' NAME_ ';' (Import ';')* (TopDecl ';')* EOF
NAME_ <- 'NAME'
Import <- 'import' ('(' (ImportSpec (';' ImportSpec)*)? ';'? ')' / ImportSpec)
ImportSpec <- ('.' / 'NAME')? 'STR'
TopDecl <- FuncDecl / Decl
Decl <- 'const' ('(' (ConstSpec (';' ConstSpec)*)? ';'? ')' / ConstSpec) / 'var' ('(' (VarSpec (';' VarSpec)*)? ';'? ')' / VarSpec)
  / 'type' ('(' (TypeSpec (';' TypeSpec)*)? ';'? ')' / TypeSpec)
Names <- 'NAME' (',' 'NAME')*
ConstSpec <- Names (Type? '=' ExprList)?
VarSpec <- Names ('=' ExprList / Type ('=' ExprList)?)
TypeSpec <- 'NAME' TypeParams '='? Type / 'NAME' '='? Type
TypeParams <- '[' TypeParam (',' TypeParam)* ','? ']'
TypeParam <- Names Union
Union <- '~'? Type ('|' '~'? Type)*
FuncDecl <- 'func' ('NAME' TypeParams? / Params 'NAME') Signature Block?
Signature <- Params (Params / Type)?
Params <- '(' (Param (',' Param)* ','?)? ')'
Param <- 'NAME' '...'? Type / '...'? Type
QName <- 'NAME' ('.' 'NAME')?
TypeArgs <- '[' Type (',' Type)* ','? ']'
Type <- QName TypeArgs? / '*' Type / '[' ']' Type / '[' ('...' / Expr) ']' Type / MapType / ChanType / 'func' Signature / StructType / InterfaceType / '(' Type ')'
MapType <- 'map' '[' Type ']' Type
ChanType <- 'chan' '<-'? Type / '<-' 'chan' Type
StructType <- 'struct' '{' (Field (';' Field)*)? ';'? '}'
Field <- (Names Type / '*'? QName TypeArgs?) 'STR'?
InterfaceType <- 'interface' '{' (IElem (';' IElem)*)? ';'? '}'
IElem <- 'NAME' Signature / Union
Block <- '{' Stmts '}'
Stmts <- (Stmt? ';')* Stmt?
Stmt <- Decl / 'return' ExprList? / 'break' 'NAME'? / 'continue' 'NAME'? / 'goto' 'NAME' / 'fallthrough' / Block / If / Switch / Select / For
  / 'go' Expr / 'defer' Expr / 'NAME' ':' Stmt? / Simple
Simple <- ExprList (AssignOp ExprList / '++' / '--' / '<-' Expr)?
AssignOp <- '=' / ':=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '&^='
If <- 'if' (XSimple? ';')? XExpr Block ('else' (If / Block))?
Switch <- 'switch' (XSimple? ';')? XSimple? '{' Clause* '}'
Clause <- ('case' Arg (',' Arg)* / 'default') ':' Stmts
Select <- 'select' '{' (('case' Simple / 'default') ':' Stmts)* '}'
For <- 'for' (Range / XSimple? ';' XExpr? ';' XSimple? / XExpr)? Block
Range <- (XExprList (':=' / '='))? 'range' XExpr
ExprList <- Expr (',' Expr)*
Expr <- Unary (BinOp Unary)*
BinOp <- '||' / '&&' / '==' / '!=' / '<' / '<=' / '>' / '>=' / '+' / '-' / '|' / '^' / '*' / '/' / '%' / '<<' / '>>' / '&' / '&^'
Unary <- ('+' / '-' / '!' / '^' / '*' / '&' / '<-') Unary / Primary
Primary <- Operand Suffix*
Operand <- 'NUM' / 'STR' / Composite / FuncLit / 'NAME' / Parens / ConvType
FuncLit <- 'func' Signature Block
Parens <- '(' (Expr / Type) ')'
ConvType <- '[' ']' Type / '[' ('...' / Expr) ']' Type / MapType / ChanType / StructType / InterfaceType / 'func' Signature
Composite <- (QName TypeArgs? / LitType) LitValue
XComposite <- LitType LitValue
LitType <- StructType / '[' '...' ']' Type / '[' Expr? ']' Type / MapType
LitValue <- '{' (Elem (',' Elem)* ','?)? '}'
Elem <- Val (':' Val)?
Val <- LitValue / Expr
Suffix <- '.' 'NAME' / '.' '(' ('type' / Type) ')' / '[' (Expr? ':' Expr? (':' Expr)? / Arg (',' Arg)* ','?) ']' / Args
Args <- '(' (Arg (',' Arg)* '...'? ','?)? ')'
Arg <- Expr !('[' / '*' / '.') / Type / Expr
%copy X: Simple ExprList Expr Unary Primary Operand, Composite=XComposite
"""

JAVA = r"""
Unit <- (Annotation* 'package' QName ';')? (Import / ';')* (TypeDecl / ';')* EOF / (Import / ';')* Annotation* "open"? "module" QName '{' Directive* '}' EOF
Directive <- "requires" ("transitive" !';' / 'static')* QName ';' / ("exports" / "opens") QName ("to" QName (',' QName)*)? ';' / "uses" QName ';' / "provides" QName "with" QName (',' QName)* ';'
Import <- 'import' 'static'? 'NAME' ('.' 'NAME')* ('.' '*')? ';'
QName <- 'NAME' ('.' 'NAME')*
Annotation <- '@' QName ('(' (ElementValue !'=' / 'NAME' '=' ElementValue (',' 'NAME' '=' ElementValue)*)? ')')?
ElementValue <- Annotation / '{' (ElementValue (',' ElementValue)*)? ','? '}' / Ternary
Modifiers <- (Annotation !'interface' / 'public' / 'protected' / 'private' / 'static' / 'abstract' / 'final' / 'native' / 'synchronized' / 'transient' / 'volatile' / 'strictfp' / 'default' / "sealed" / "non" '-' "sealed")*
TypeDecl <- Modifiers TypeKind
TypeKind <- Class / Interface / Enum / Record / '@' 'interface' 'NAME' '{' AnnoMember* '}'
Class <- 'class' 'NAME' TypeParams? ('extends' Type)? ('implements' Types)? ("permits" Types)? ClassBody
Interface <- 'interface' 'NAME' TypeParams? ('extends' Types)? ("permits" Types)? ClassBody
Enum <- 'enum' 'NAME' ('implements' Types)? '{' (EnumConst (',' EnumConst)*)? ','? (';' Member*)? '}'
EnumConst <- Annotation* 'NAME' Args? ClassBody?
Record <- "record" 'NAME' TypeParams? Params ('implements' Types)? ClassBody
AnnoMember <- ';' / TypeDecl / Modifiers Type ('NAME' '(' ')' Dims ('default' ElementValue)? / VarDecl (',' VarDecl)*) ';'
ClassBody <- '{' Member* '}'
Member <- ';' / 'static'? Block / TypeDecl / Modifiers TypeParams? MemberRest
MemberRest <- 'NAME' Params Throws? Block / ('void' / Type) 'NAME' Params Dims Throws? (Block / ';') / Type VarDecl (',' VarDecl)* ';' / 'NAME' Block
Throws <- 'throws' Types
Types <- Type (',' Type)*
TypeParams <- '<' TypeParam (',' TypeParam)* '>'
TypeParam <- Annotation* 'NAME' ('extends' Type ('&' Type)*)?
Dims <- (Annotation* '[' ']')*
Primitive <- 'boolean' / 'byte' / 'char' / 'short' / 'int' / 'long' / 'float' / 'double'
Type <- Annotation* (Primitive / ClassType) Dims
ClassType <- 'NAME' TypeArgs? ('.' Annotation* 'NAME' TypeArgs?)*
TypeArgs <- '<' (TypeArg (',' TypeArg)*)? '>'
TypeArg <- Annotation* '?' (('extends' / 'super') Type)? / Type
Params <- '(' (Param (',' Param)*)? ')'
Param <- Modifiers Type (Annotation* '...')? ('NAME' '.' 'this' / 'NAME' / 'this') Dims
Block <- '{' BlockStmt* '}'
BlockStmt <- Modifiers (Class / Interface / Enum / Record) / LocalVar ';' / Stmt
LocalVar <- Modifiers Type VarDecl (',' VarDecl)*
VarDecl <- 'NAME' Dims ('=' (ArrayInit / Expr))?
ArrayInit <- '{' ((ArrayInit / Expr) (',' (ArrayInit / Expr))*)? ','? '}'
Paren <- '(' Expr ')'
Stmt <- Block / ';' / 'if' Paren Stmt ('else' Stmt)? / For / 'while' Paren Stmt / 'do' Stmt 'while' Paren ';' / Try / Switch !('.' / '[') / 'synchronized' Paren Block
  / 'return' Expr? ';' / 'throw' Expr ';' / 'break' 'NAME'? ';' / 'continue' 'NAME'? ';' / 'assert' Expr (':' Expr)? ';' / 'NAME' ':' Stmt / "yield" !('=' / '.' / '(' / '[' / '++' / '--') Expr ';' / StmtExpr ';'
For <- 'for' '(' (Modifiers Type 'NAME' Dims ':' Expr / (LocalVar / StmtExprs)? ';' Expr? ';' StmtExprs?) ')' Stmt
StmtExprs <- StmtExpr (',' StmtExpr)*
StmtExpr <- ('++' / '--') Unary / Primary AssignOp Expr / Primary ('++' / '--') / Primary BEFORE[) }]
AssignOp <- '=' / '+=' / '-=' / '*=' / '/=' / '&=' / '|=' / '^=' / '%=' / '<<=' / '>' '>' '='  / '>' '>' '>' '='
Try <- 'try' ('(' Resource (';' Resource)* ';'? ')' Block Catch* Finally? / Block (Catch+ Finally? / Finally))
Resource <- Modifiers Type 'NAME' '=' Expr / Primary
Catch <- 'catch' '(' Modifiers Type ('|' Type)* 'NAME' ')' Block
Finally <- 'finally' Block
Switch <- 'switch' Paren '{' (SwitchLabel ('->' (Block / 'throw' Expr ';' / Expr ';') / ':' BlockStmt*))* '}'
SwitchLabel <- 'case' CaseItem (',' CaseItem)* ("when" Expr)? / 'default'
CaseItem <- 'default' / Pattern &('->' / ':' / ',' / 'NAME') / Ternary
Pattern <- Modifiers Type ('(' (Pattern (',' Pattern)*)? ')' 'NAME'? / 'NAME')
Expr <- Lambda / Ternary (AssignOp Expr)?
Lambda <- ('NAME' / '(' ('NAME' (',' 'NAME')*)? ')' / Params) '->' (Block / Expr)
Ternary <- Binary ('?' Expr ':' (Lambda / Ternary))?
Binary <- Unary (BinOp Unary / 'instanceof' (Pattern / 'final'? Type))*
BinOp <- '||' / '&&' / '|' / '^' / '&' / '==' / '!=' / '<=' / '<<' / '<' / '>' '>' '>' !'=' / '>' '>' !'=' / '>' '=' / '>' !'>' / '+' / '-' / '*' / '/' / '%'
Unary <- ('+' / '-' / '++' / '--' / '!' / '~') Unary / Cast / Primary ('++' / '--')*
Cast <- '(' Annotation* Primitive Dims ')' Unary / '(' Type ('&' Type)* ')' (Lambda / &('NAME' / 'NUM' / 'STR' / 'CHAR' / '(' / '!' / '~' / 'this' / 'super' / 'new' / 'true' / 'false' / 'null' / 'switch' / 'void' / Primitive) Unary)
Primary <- Atom Suffix*
Atom <- 'NUM' / 'STR' / 'CHAR' / 'true' / 'false' / 'null' / Switch / New / Paren / (Primitive Dims / 'void') '.' 'class' / Type '::' TypeArgs? ('NAME' / 'new') / ClassType '[' ']' Dims '.' 'class' / 'NAME' / 'this' / 'super'
New <- 'new' TypeArgs? Annotation* ((Primitive / ClassType) (Dims &'{' ArrayInit / ('[' Expr ']')+ Dims) / ClassType Args ClassBody?)
Suffix <- '.' (TypeArgs? 'NAME' / 'class' / 'this' / 'super' / New / TypeArgs 'super') / Args / '[' Expr ']' / '::' TypeArgs? ('NAME' / 'new')
Args <- '(' (Expr (',' Expr)*)? ')'
"""

_JS = r"""
Program <- Item* EOF
Item <- Import / Export / Stmt
Block <- '{' Stmt* '}'
EOS <- ';' / &'}' / &'EOF' / NL
Stmt <- Block / ';' / VarStmt / Function / Class / TSDecl / 'if' Paren Stmt ('else' Stmt)? / For / 'while' Paren Stmt / 'do' Stmt 'while' Paren ';'? / Try / 'switch' Paren '{' (('case' Expr / 'default') ':' Stmt*)* '}'
  / 'return' (NONL !';' !'}' Expr)? EOS / 'throw' NONL Expr EOS / ('break' / 'continue') (NONL 'NAME')? EOS / 'debugger' EOS / 'with' Paren Stmt / Name ':' Stmt / ExprStmt
ExprStmt <- !('{' / 'function' / 'class') Expr EOS
Paren <- '(' Expr ')'
Name <- 'NAME' / 'await' / 'yield' / 'static' / 'let'
VarStmt <- Using? ('var' / 'let' &('NAME' / '[' / '{' / 'yield' / 'await' / 'static')) VarDecl (',' VarDecl)* EOS / 'const' !'enum' ConstDecl (',' ConstDecl)* EOS
  / ('await' NONL)? "using" NONL UsingDecl (',' UsingDecl)* EOS
UsingDecl <- NONL Name Ann? Init
Using <- NEVER
VarDecl <- Pattern Init? / Name '!'? Ann? Init?
ConstDecl <- (Pattern / Name Ann?) Init
Pattern <- (ArrayPattern / ObjectPattern) Ann?
Binding <- Name / ArrayPattern / ObjectPattern
ArrayPattern <- '[' (','* ('...' Binding / Binding Init?) (','+ ('...' Binding / Binding Init?))*)? ','* ']'
ObjectPattern <- '{' (PatProp (',' PatProp)*)? ','? '}'
PatProp <- '...' Binding / PropName ':' Binding Init? / Name Init?
Init <- '=' Assign
For <- 'for' 'await'? '(' (('var' / 'let' / 'const' / 'await'? "using" !("of" / 'in')) Binding Ann? ("of" Assign / 'in' Expr) / !'let' ((AObject / AArray) &("of" / 'in') / LHS) ("of" Assign / 'in' Expr) / (ForVar / Expr)? ';' Expr? ';' Expr?) ')' Stmt
ForVar <- ('var' / 'let') VarDecl (',' VarDecl)* / 'const' ConstDecl (',' ConstDecl)*
Try <- 'try' Block ('catch' ('(' Binding Ann? ')')? Block ('finally' Block)? / 'finally' Block)
Import <- 'import' !('(' / '.') ('STR' / "type"? ImportClause "from" 'STR') Attributes? EOS / ImportEquals
ImportEquals <- NEVER
ImportClause <- Name (',' (Named / '*' "as" Name))? / Named / '*' "as" Name
Named <- '{' (Spec (',' Spec)*)? ','? '}'
Spec <- ("type" !("as" !'NAME' / ',' / '}'))? (WORD / 'STR') ("as" (WORD / 'STR'))?
Attributes <- ('with' / "assert") '{' ((WORD / 'STR') ':' 'STR' (',' (WORD / 'STR') ':' 'STR')*)? ','? '}'
Export <- Decorator* 'export' ('default' (Function / Class / Abstract / TSDecl / Assign EOS) / "type"? '*' ("as" (WORD / 'STR'))? "from" 'STR' Attributes? EOS / "type"? Named ("from" 'STR' Attributes?)? EOS / ExportTS / VarStmt / Function / Class / TSDecl)
ExportTS <- NEVER
Function <- ("async" NONL)? 'function' '*'? Name? TParams? Params Ret? (Block / Overload)
Overload <- NEVER
Params <- '(' (Param (',' Param)*)? ','? ')'
Param <- Decorator* ParamMod* ('...' Binding Ann? / ('this' / Binding) Opt? Ann? Init?)
ParamMod <- NEVER
Opt <- NEVER
Decorator <- '@' (Paren / Name ('.' WORD)* Args?)
Class <- Decorator* 'class' Name? TParams? ('extends' LHS TArgs?)? Implements? ClassBody
Implements <- NEVER
ClassBody <- '{' (';' / ClassMember)* '}'
ClassMember <- Decorator* ('static' Block / Mod* (Accessor / Method / Index / Field))
Mod <- ('static' / "accessor" / TSMod) !('(' / '=' / ';' / ':' / '?' / '}' / '<' / '!')
TSMod <- NEVER
Index <- NEVER
Accessor <- ("get" / "set") PropName Params Ret? (Block / Overload)
Method <- ("async" NONL)? '*'? PropName '?'? TParams? Params Ret? (Block / Overload)
Field <- PropName FieldMark? Ann? Init? EOS
FieldMark <- NEVER
PropName <- WORD / 'STR' / 'NUM' / 'PRIVATE' / '[' Assign ']'
Expr <- Assign (',' Assign)*
Assign <- Arrow / Yield / (AObject / AArray) '=' Assign / !('NUM' / 'STR') LHS AssignOp Assign / Cond
AObject <- '{' (AProp (',' AProp)*)? ','? '}'
AProp <- '...' LHS / PropName ':' AElem Init? / Name Init?
AElem <- (AObject / AArray) &(',' / '}' / ']' / '=') / LHS
AArray <- '[' (','* '...'? AElem Init? (','+ '...'? AElem Init?)*)? ','* ']'
Yield <- 'yield' (NONL '*'? Assign)?
AssignOp <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '**=' / '<<=' / '&=' / '|=' / '^=' / '&&=' / '||=' / '??=' / '>' '>' '>' '=' / '>' '>' '='
Arrow <- ("async" NONL)? (Name / TParams? Params Ret?) NONL '=>' (Block / !'{' Assign)
Cond <- Binary ('?' Assign ':' Assign)?
Binary <- Unary (BinOp Unary / AsType)* / 'PRIVATE' 'in' Unary
AsType <- NEVER
BinOp <- '??' / '||' / '&&' / '|' / '^' / '&' / '===' / '!==' / '==' / '!=' / '<=' / '<<' / '<' / '>' '>' '>' !'=' / '>' '>' !'=' / '>' '=' / '>' !'>' / 'instanceof' / 'in' / '+' / '-' / '**' / '*' / '/' / '%'
Unary <- ('!' / '~' / '+' / '-' / '++' / '--' / 'typeof' / 'void' / 'delete' / 'await') Unary / Assertion / LHS (NONL ('++' / '--'))?
Assertion <- NEVER
LHS <- (New / Primary) Suffix*
New <- 'new' ('.' "target" / (New / Primary) Access* TArgs? Args?)
Access <- '.' (WORD / 'PRIVATE') / '[' Expr ']' / Template / NonNull
NonNull <- NEVER
Suffix <- Access / '?.' (TArgs? Args / '[' Expr ']' / WORD / 'PRIVATE' / Template) / Args / TArgs (Args / Template / !(Primary / '(' / '`' / '+' / '-'))
Args <- '(' (('...'? Assign) (',' '...'? Assign)*)? ','? ')'
Primary <- Function / 'NAME' / 'static' / 'let' / 'await' / 'yield' / 'NUM' / 'STR' / 'REGEX' / Template / 'this' / 'super' / 'null' / 'true' / 'false' / Array / Object / Class / Paren / 'import' ('(' Assign (',' Assign)? ','? ')' / '.' 'NAME') / Jsx
Template <- '`' ('${' Expr '}$')* '`end'
Array <- '[' (','* '...'? Assign (','+ '...'? Assign)*)? ','* ']'
Object <- '{' (Prop (',' Prop)*)? ','? '}'
Prop <- '...' Assign / ("get" / "set") PropName Params Ret? Block / ("async" NONL)? '*'? PropName TParams? Params Ret? Block / PropName ':' Assign / Name
Jsx <- NEVER
TSDecl <- NEVER
Abstract <- NEVER
Ann <- NEVER
Ret <- NEVER
TParams <- NEVER
TArgs <- NEVER
"""

_TS = r"""
Opt <- '?'
Overload <- EOS
ParamMod <- ("public" / "private" / "protected" / "readonly" / "override") &('NAME' / '{' / '[' / 'this')
Implements <- "implements" TypeRef (',' TypeRef)*
TSMod <- "public" / "private" / "protected" / "readonly" / "abstract" / "override" / "declare"
Index <- '[' 'NAME' ':' Type ']' Ann EOS
FieldMark <- '?' / '!'
ImportEquals <- 'import' "type"? Name '=' ("require" '(' 'STR' ')' / QName) EOS
ExportTS <- '=' Expr EOS / "as" "namespace" 'NAME' EOS / 'import' Name '=' QName EOS
Ann <- ':' Type
Ret <- ':' ("asserts" ('NAME' / 'this') ("is" Type)? / ('NAME' / 'this') "is" Type / Type)
AsType <- NONL ("as" ('const' / Type) / "satisfies" Type)
NonNull <- NONL '!' !('=' / '==')
TSDecl <- "interface" NONL 'NAME' TParams? ('extends' TypeRef (',' TypeRef)*)? ObjType / "type" NONL 'NAME' TParams? '=' Type EOS / 'const'? 'enum' 'NAME' '{' (EnumMember (',' EnumMember)*)? ','? '}'
  / "declare" NONL ('const' Name Ann? (',' Name Ann?)* EOS / VarStmt / Function / Class / TSDecl / "global" Block_ / "module" 'STR' (Block_ / EOS)) / ("namespace" / "module") NONL (QName / 'STR') Block_ / Abstract
Block_ <- '{' ('export'? 'const' Name Ann (',' Name Ann)* EOS / Item)* '}'
Abstract <- Decorator* "abstract" NONL Class
EnumMember <- PropName ('=' Assign)?
TParams <- '<' TParam (',' TParam)* ','? '>'
TParam <- ('const' / 'in' / "out")* 'NAME' ('extends' Type)? ('=' Type)?
TArgs <- '<' Type (',' Type)* '>'
QName <- (Name / 'this') ('.' WORD)*
TypeRef <- QName TArgs?
Type <- "abstract"? 'new' TParams? Params '=>' Type / TParams? Params '=>' ("asserts" ('NAME' / 'this') ("is" Type)? / ('NAME' / 'this') "is" Type / Type) / Union ('extends' Union '?' Type ':' Type)?
Union <- '|'? Inter ('|' Inter)*
Inter <- '&'? TUnary ('&' TUnary)*
TUnary <- ("keyof" / "unique" / "readonly" / "infer") TUnary ('extends' Union !'?')? / TPrim (NONL '[' Type? ']')*
TPrim <- '(' Type ')' / 'STR' / 'NUM' / '-' 'NUM' / 'true' / 'false' / 'null' / 'void' / TTemplate / 'typeof' ('import' '(' 'STR' ')' ('.' WORD)* / QName) TArgs? / 'import' '(' 'STR' ')' ('.' WORD)* TArgs? / ObjType / Tuple / QName (NONL TArgs)?
TTemplate <- '`' ('${' Type '}$')* '`end'
Tuple <- '[' (TElem (',' TElem)*)? ','? ']'
TElem <- '...'? ('NAME' '?'? ':' Type / Type '?'?)
ObjType <- '{' (TMember (';' / ',' / &'}' / NL))* '}'
TMember <- ("readonly" / '+' "readonly" / '-' "readonly")? '[' 'NAME' 'in' Type ("as" Type)? ']' (('+' / '-')? '?')? Ann? / "readonly"? '[' 'NAME' ':' Type ']' Ann / 'new'? TParams? Params Ret? / ("get" / "set") PropName Params Ret? / ("readonly" !(':' / '?' / '(' / '<'))? PropName '?'? (TParams? Params Ret? / Ann?)
"""

_ASSERTION = r"""
Assertion <- '<' (Type / 'const') '>' Unary
"""

_JSX = r"""
Jsx <- 'J<' JName TArgs? JAttr* (JClose / JOpenEnd JChild* 'J</' JName JOpenEnd) / 'J<' JOpenEnd JChild* 'J</' JOpenEnd
JOpenEnd <- 'J>' / 'J>!'
JClose <- 'J/>' / 'J/>!'
JName <- 'JNAME' ('J.' 'JNAME')*
JAttr <- 'J{' '...' Assign 'J}' / 'JNAME' ('J=' ('STR' / 'J{' Assign 'J}' / Jsx))?
JChild <- 'JTEXT' / 'J{' ('...'? Expr)? 'J}' / Jsx
"""

RUST = r"""
Crate <- InnerAttr* Item* EOF
InnerAttr <- '#' '!' '[' Tree* ']'
Attr <- '#' '[' Tree* ']'
Tree <- '(' Tree* ')' / '[' Tree* ']' / '{' Tree* '}' / TOKEN
Item <- Attr* (Vis? Kind / MacroRules / MacroItem)
Vis <- 'pub' ('(' ('crate' / 'self' / 'super' / 'in' Path) ')')? / 'crate' !'::'
Kind <- Use / Fn / Struct / Enum / Const / TypeAlias / Trait / Impl / Mod / Extern
MacroRules <- "macro_rules" '!' 'NAME' ('{' Tree* '}' / '(' Tree* ')' ';' / '[' Tree* ']' ';')
MacroItem <- Path '!' ('{' Tree* '}' / '(' Tree* ')' ';' / '[' Tree* ']' ';')
Use <- 'use' UseTree ';'
UseTree <- '::'? (Segment_ '::')* ('*' / '{' (UseTree (',' UseTree)*)? ','? '}' / Segment_ ('as' ('NAME' / "_"))?)
Segment_ <- 'NAME' / 'self' / 'super' / 'crate' / 'Self'
Fn <- ('const' / 'async' / 'unsafe' / 'extern' 'STR'?)* 'fn' 'NAME' Generics? '(' (FnParam (',' FnParam)*)? ','? ')' ('->' Type)? Where? (Block / ';')
FnParam <- Attr* ('&' 'LIFE'? 'mut'? 'self' / 'mut'? 'self' (':' Type)? / '...' / PatAlt ':' Type)
Struct <- ('struct' / "union") 'NAME' Generics? Where? ('{' (NamedField (',' NamedField)*)? ','? '}' / '(' (TupleField (',' TupleField)*)? ','? ')' Where? ';' / ';')
NamedField <- Attr* Vis? 'NAME' ':' Type
TupleField <- Attr* Vis? Type
Enum <- 'enum' 'NAME' Generics? Where? '{' (Variant (',' Variant)*)? ','? '}'
Variant <- Attr* Vis? 'NAME' ('{' (NamedField (',' NamedField)*)? ','? '}' / '(' (TupleField (',' TupleField)*)? ','? ')')? ('=' Expr)?
Const <- ('const' / 'static' 'mut'?) ('NAME' / "_") ':' Type ('=' Expr)? ';'
TypeAlias <- 'type' 'NAME' Generics? (':' Bounds?)? Where? ('=' Type)? Where? ';'
Trait <- 'unsafe'? "auto"? 'trait' 'NAME' Generics? (':' Bounds?)? Where? '{' InnerAttr* Item* '}'
Impl <- 'unsafe'? 'impl' Generics? '!'? Type ('for' Type)? Where? '{' InnerAttr* Item* '}'
Mod <- 'unsafe'? 'mod' 'NAME' (';' / '{' InnerAttr* Item* '}')
Extern <- 'extern' 'crate' ('NAME' / 'self') ('as' ('NAME' / "_"))? ';' / 'unsafe'? 'extern' 'STR'? '{' InnerAttr* Item* '}'
Generics <- '<' (GenericParam (',' GenericParam)*)? ','? '>'
GenericParam <- Attr* ('LIFE' (':' ('LIFE' ('+' 'LIFE')*)?)? / 'const' 'NAME' ':' Type ('=' Expr_)? / 'NAME' (':' Bounds?)? ('=' Type)?)
Expr_ <- Block / '-'? ('NUM' / 'STR') / 'true' / 'false' / 'NAME'
Where <- 'where' (WhereItem (',' WhereItem)*)? ','?
WhereItem <- 'LIFE' ':' ('LIFE' ('+' 'LIFE')*)? / ForLife? Type ':' Bounds?
ForLife <- 'for' Generics
Bounds <- Bound ('+' Bound)* '+'?
Bound <- 'LIFE' / '(' '?'? ForLife? Path ')' / '?'? '~'? 'const'? ForLife? Path / 'use' Generics
Path <- '::'? Segment ('::' Segment)* / '<' Type ('as' Path)? '>' ('::' Segment)+
Segment <- Segment_ ('::'? GenericArgs / '(' (Type (',' Type)*)? ','? ')' ('->' Type)?)?
GenericArgs <- '<' (GenericArg (',' GenericArg)*)? ','? '>'
GenericArg <- 'LIFE' / 'NAME' GenericArgs? ('=' Type / ':' Bounds) / Type / Expr_
Type <- '(' (Type (',' Type)*)? ','? ')' / '!' / ('&' / '&&') 'LIFE'? 'mut'? Type / '*' ('const' / 'mut') Type / '[' Type (';' Expr)? ']' / ForLife? ('unsafe' / 'extern' 'STR'? / 'async')* 'fn' '(' (FnArg (',' FnArg)*)? ','? ')' ('->' Type)?
  / ('impl' / 'dyn') Bounds / ForLife Path / Path '!' ('(' Tree* ')' / '[' Tree* ']' / '{' Tree* '}') / Path
FnArg <- Attr* (('NAME' / "_") ':')? ('...' / Type)
Pattern <- '|'? PatAlt ('|' PatAlt)*
PatAlt <- RangePat / ('ref' / 'mut')* 'NAME' !('::' / '(' / '{' / '!') ('@' PatAlt)? / ('ref' 'mut'? / 'mut') 'NAME' ('@' PatAlt)? / ('&' / '&&') 'mut'? PatAlt / '(' (Pattern (',' Pattern)*)? ','? ')' / '[' (Pattern (',' Pattern)*)? ','? ']' / '..'
  / PPath '!' ('(' Tree* ')' / '[' Tree* ']' / '{' Tree* '}') / PPath ('(' (Pattern (',' Pattern)*)? ','? ')' / '{' (FieldPat (',' FieldPat)*)? ','? '}')? / 'const' Block
RangePat <- PatLit (('..=' / '...' / '..') PatLit?)? / PPath ('..=' / '...') PatLit / ('..=' / '..') PatLit
PatLit <- '-'? 'NUM' / 'STR' / 'true' / 'false' / PPath &('..=' / '...')
PPath <- '::'? PSeg ('::' PSeg)* / '<' Type ('as' Path)? '>' ('::' PSeg)+
PSeg <- Segment_ ('::' GenericArgs)?
FieldPat <- Attr* ('..' / ('NAME' / 'NUM') ':' Pattern / ('ref' / 'mut')* 'NAME')
Block <- '{' InnerAttr* Stmt* Expr? '}'
Stmt <- ';' / Attr* Let / Item / Attr* BlockLike !('.' / '?') ';'? / Attr* Path '!' '{' Tree* '}' !('.' / '?') / Attr* Expr ';'
Let <- 'let' Pattern (':' Type)? ('=' Expr ('else' Block)?)? ';'
Expr <- Attr* Range (AssignOp Expr)?
AssignOp <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '^=' / '&=' / '|=' / '<<=' / '>' '>' '='
Range <- ('..=' / '..') Binary? / Binary (('..=' / '..') Binary?)?
Binary <- Unary (BinOp Unary / 'as' Type)*
BinOp <- '||' / '&&' / '==' / '!=' / '<=' / '<<' / '<' / '>' '>' !'=' / '>' '=' / '>' !'>' / '|' / '^' / '&' / '+' / '-' / '*' / '/' / '%'
Unary <- ('-' / '!' / '*') Unary / ('&' / '&&') ("raw" ('const' / 'mut'))? 'mut'? Unary / Postfix
Postfix <- Primary (Post)*
Post <- '?' / '.' ('await' / 'NAME' ('::' GenericArgs)? / 'NUM') / CallArgs / '[' Expr ']'
ArrayLit <- '[' (Expr ';' Expr / (Expr (',' Expr)*)? ','?) ']'
CallArgs <- '(' (Expr (',' Expr)*)? ','? ')'
Primary <- 'NUM' / 'STR' / 'true' / 'false' / Closure / BlockLike / 'return' Expr? / 'break' 'LIFE'? Expr? / 'continue' 'LIFE'? / "yield" Expr / CallArgs / ArrayLit / Macro / StructLit / EPath / "_"
Macro <- Path '!' ('(' Tree* ')' / '[' Tree* ']' / '{' Tree* '}')
StructLit <- EPath '{' (FieldInit (',' FieldInit)*)? ','? '}'
FieldInit <- Attr* ('..' Expr? / ('NAME' / 'NUM') (':' Expr)?)
EPath <- '::'? ESeg ('::' ESeg)* / '<' Type ('as' Path)? '>' ('::' ESeg)+
ESeg <- Segment_ ('::' GenericArgs)?
Closure <- ForLife? 'static'? 'async'? 'move'? ('||' / '|' (CParam (',' CParam)*)? ','? '|') ('->' Type Block / Expr)
CParam <- Attr* PatAlt (':' Type)?
BlockLike <- ('LIFE' ':')? ('unsafe' Block / 'async' 'move'? Block / 'const' Block / Block / If / 'match' XExpr '{' InnerAttr* Arm* '}' / 'while' Cond Block / 'loop' Block / 'for' Pattern 'in' XExpr Block)
If <- 'if' Cond Block ('else' (If / Block))?
Cond <- CondAtom ('&&' CondAtom)*
CondAtom <- 'let' Pattern '=' LetExpr / XExpr
LetExpr <- XRange
Arm <- Attr* Pattern ('if' Cond_)? '=>' (BlockLike !('.' / '?') ','? / Expr (',' / &'}'))
Cond_ <- CondAtom_ ('&&' CondAtom_)*
CondAtom_ <- 'let' Pattern '=' Range / Expr
%copy X: Expr Range Binary Unary Postfix Primary, StructLit=NEVER
"""

PYTHON = r"""
File <- ('NEWLINE' / Stmt)* EOF
Stmt <- Compound / SimpleStmts
SimpleStmts <- Simple (';' Simple)* ';'? 'NEWLINE'
Simple <- Assignment / TypeAlias / StarExprs / 'return' StarExprs? / ImportStmt / 'raise' (Expr ('from' Expr)?)? / 'pass' / 'del' DelTarget (',' DelTarget)* ','? / Yield / 'assert' Expr (',' Expr)? / 'break' / 'continue' / ('global' / 'nonlocal') 'NAME' (',' 'NAME')*
TypeAlias <- "type" 'NAME' TypeParams? '=' Expr
Assignment <- (Single / '(' Single ')') ':' Expr ('=' (Yield / StarExprs))? / (StarTargets '=')+ !(StarTargets '=') (Yield / StarExprs) / Single AugOp (Yield / StarExprs)
AugOp <- '+=' / '-=' / '*=' / '@=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '**=' / '//='
Single <- Attribute / 'NAME' !('(' / '[' / '.') / '(' Single ')'
Attribute <- Atom Suffix+ BEFORE[NAME ]] !('(' / '[' / '.')
StarTargets <- StarTarget (',' StarTarget)* ','?
StarTarget <- '*' !'*' Target / Target
Target <- Single / '(' StarTargets? ')' !('(' / '[' / '.') / '[' StarTargets? ']' !('(' / '[' / '.')
DelTarget <- Single / '(' (DelTarget (',' DelTarget)* ','?)? ')' / '[' (DelTarget (',' DelTarget)* ','?)? ']'
ImportStmt <- 'import' Dotted ('as' 'NAME')? (',' Dotted ('as' 'NAME')?)* / 'from' (('.' / '...')* Dotted / ('.' / '...')+) 'import' ('*' / '(' ImportName (',' ImportName)* ','? ')' / ImportName (',' ImportName)*)
ImportName <- 'NAME' ('as' 'NAME')?
Dotted <- 'NAME' ('.' 'NAME')*
Block <- 'NEWLINE' 'INDENT' Stmt+ 'DEDENT' / SimpleStmts
Compound <- If / 'while' Named ':' Block Else? / For / Try / With / FunctionDef / ClassDef / Decorated / 'async' (For / With / FunctionDef) / Match
If <- 'if' Named ':' Block ('elif' Named ':' Block)* Else?
Else <- 'else' ':' Block
For <- 'for' StarTargets 'in' StarExprs ':' Block Else?
Try <- 'try' ':' Block ('finally' ':' Block / (Except+ / ExceptStar+) Else? ('finally' ':' Block)?)
Except <- 'except' (Expr (',' Expr)* ('as' 'NAME')?)? ':' Block
ExceptStar <- 'except' '*' Expr (',' Expr)* ('as' 'NAME')? ':' Block
With <- 'with' ('(' WithItem (',' WithItem)* ','? ')' ':' / WithItem (',' WithItem)* ':') Block
WithItem <- Expr ('as' StarTarget &(',' / ')' / ':'))?
FunctionDef <- 'def' 'NAME' TypeParams? '(' Params? ')' ('->' Expr)? ':' Block
ClassDef <- 'class' 'NAME' TypeParams? ('(' CallArgs? ')')? ':' Block
Decorated <- ('@' Named 'NEWLINE')+ ('async'? FunctionDef / ClassDef)
TypeParams <- '[' TypeParam (',' TypeParam)* ','? ']'
TypeParam <- ('*' / '**')? 'NAME' (':' Expr)? ('=' StarExpr)?
Params <- Plains ',' '/' (',' Rest)? ','? / (Plains ',')? Filled ',' '/' (',' (Filled (',' Star)? / Star))? ','? / Rest
Plains <- Plain (',' Plain)*
Plain <- 'NAME' (':' Expr)? !'='
Filled <- Fill (',' Fill)*
Fill <- 'NAME' (':' Expr)? '=' Expr
Rest <- (Plains (',' Filled)? / Filled) (',' Star)? ','? / Star ','?
Star <- '*' 'NAME' (':' StarExpr)? (',' Param)* (',' KwArgs)? / '*' (',' Param)+ (',' KwArgs)? / KwArgs
KwArgs <- '**' 'NAME' (':' Expr)?
Param <- 'NAME' (':' Expr)? ('=' Expr)?
Match <- "match" Subject ':' 'NEWLINE' 'INDENT' Case+ 'DEDENT'
Subject <- StarNamed ',' (StarNamed (',' StarNamed)* ','?)? / Named
Case <- "case" Patterns ('if' Named)? ':' Block
Patterns <- StarPat (',' StarPat)* ','?
StarPat <- '*' 'NAME' / AsPat
AsPat <- OrPat ('as' 'NAME')?
OrPat <- ClosedPat ('|' ClosedPat)*
ClosedPat <- '-'? 'NUM' (('+' / '-') 'NUM')? / 'STR'+ / 'None' / 'True' / 'False' / Dotted ('(' (PatArg (',' PatArg)*)? ','? ')')? / '(' Patterns? ')' / '[' Patterns? ']' / '{' (MapItem (',' MapItem)*)? ','? '}'
PatArg <- 'NAME' '=' AsPat / AsPat
MapItem <- '**' 'NAME' / ('-'? 'NUM' (('+' / '-') 'NUM')? / 'STR'+ / 'None' / 'True' / 'False' / Dotted) ':' AsPat
Yield <- 'yield' ('from' Expr / StarExprs?)
StarExprs <- StarExpr (',' StarExpr)* ','?
StarExpr <- '*' BitOr / Expr
StarNamed <- '*' BitOr / Named
Named <- 'NAME' ':=' Expr / Expr !':='
Expr <- Lambda / Disj ('if' Disj 'else' Expr)?
Lambda <- 'lambda' LParams? ':' Expr
LParams <- LPlains ',' '/' (',' LRest)? ','? / (LPlains ',')? LFilled ',' '/' (',' (LFilled (',' LStar)? / LStar))? ','? / LRest
LPlains <- LPlain (',' LPlain)*
LPlain <- 'NAME' !'='
LFilled <- LFill (',' LFill)*
LFill <- 'NAME' '=' Expr
LRest <- (LPlains (',' LFilled)? / LFilled) (',' LStar)? ','? / LStar ','?
LStar <- '*' 'NAME' (',' LParam)* (',' '**' 'NAME')? / '*' (',' LParam)+ (',' '**' 'NAME')? / '**' 'NAME'
LParam <- 'NAME' ('=' Expr)?
Disj <- 'not'* BitOr (CompOp BitOr / ('and' / 'or') 'not'* BitOr)*
CompOp <- '==' / '!=' / '<=' / '<' / '>=' / '>' / 'not' 'in' / 'in' / 'is' 'not' / 'is'
BitOr <- Factor (('|' / '^' / '&' / '<<' / '>>' / '+' / '-' / '*' / '/' / '//' / '%' / '@') Factor)*
Factor <- ('+' / '-' / '~') Factor / 'await'? Atom Suffix* ('**' Factor)?
Suffix <- '.' 'NAME' / '(' CallArgs? ')' / '[' Slices ']'
Slices <- (Slice / '*' BitOr) (',' (Slice / '*' BitOr))* ','?
Slice <- Expr? ':' Expr? (':' Expr?)? / Named
CallArgs <- Arg CompFor &')' / PosArg (',' PosArg)* (',' KwArg (',' KwOrStar)*)? ','? / KwArg (',' KwOrStar)* ','?
Arg <- Named
PosArg <- '*' Expr / Named !('=' / 'for' / 'async')
KwArg <- 'NAME' '=' Expr / '**' Expr
KwOrStar <- KwArg / '*' Expr
CompFor <- ('async'? 'for' StarTargets 'in' Disj ('if' DisjIf)*)+
DisjIf <- 'NAME' ':=' NEVER / Disj
Atom <- 'NAME' / 'NUM' / 'STR'+ / 'None' / 'True' / 'False' / '...' / '(' (Yield / Named CompFor / StarNamed ',' (StarNamed (',' StarNamed)* ','?)? / Named)? ')' / '[' (Named CompFor / StarNamed (',' StarNamed)* ','?)? ']' / '{' (Pair CompFor / Named CompFor / Entry (',' Entry)* ','? / StarNamed (',' StarNamed)* ','?)? '}'
Pair <- Expr ':' Expr
Entry <- '**' BitOr / Pair
"""


def _override(base: str, *more: str) -> str:
    """``base`` with the rules of ``more`` in place of its rules of the same name."""
    return "\n".join([base, *more])


_ALL = {
    "go": (lexers.go, GO, lexers.GO, "File"),
    "java": (lexers.java, JAVA, lexers.JAVA, "Unit"),
    "javascript": (lexers.javascript, _JS, lexers.JS, "Program"),
    "typescript": (lexers.typescript, _override(_JS, _TS, _ASSERTION), lexers.JS, "Program"),
    "tsx": (lexers.tsx, _override(_JS, _TS, _JSX), lexers.JS, "Program"),
    "rust": (lexers.rust, RUST, lexers.RUST, "Crate"),
    "python": (lexers.python, PYTHON, lexers.PYTHON, "File"),
}
LANGUAGES = tuple(_ALL)
_BUILT: dict[str, tuple] = {}


def check(language: str, text: str, trace: bool = True) -> tuple[int, str] | None:
    """None if all of ``text`` is a file of ``language``, else the place of the furthest failure and what stands there."""
    if language not in _BUILT:
        lex, grammar, words, start = _ALL[language]
        _BUILT[language] = lex, Parser(grammar, words, start)
    lex, parser = _BUILT[language]
    try:
        kinds, texts, breaks, places = lex(text)
    except lexers.LexError as e:
        return e.place, e.what
    far = parser.parse(kinds, texts, breaks, trace)
    return None if far < 0 else (places[far], "end of file" if kinds[far] == "EOF" else texts[far] or kinds[far].lower())
