"""Language table: markers by language, from public language definitions. A small dimension, some 300 rows."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Language:
    key: str
    extensions: tuple[str, ...]
    line: tuple[str, ...] = ()
    block: tuple[tuple[str, str], ...] = ()
    quotes: tuple[tuple[str, str], ...] = ()
    verbatim: tuple[tuple[str, str], ...] = ()
    doc_quotes: tuple[tuple[str, str], ...] = ()
    nested: bool = False
    nested_comments: tuple[tuple[str, str], ...] = ()
    literate: bool = False
    name: str | None = None

    @property
    def trivial(self) -> bool:
        return not (self.line or self.block or self.quotes or self.verbatim or self.doc_quotes or self.nested_comments)


_C = (("/*", "*/"),)
_D = ('"', '"')
_S = ("'", "'")

# Comment and string markers of each language.
TABLE = [
    Language("C", ("c",), ("//",), _C, (_D,)),
    Language("CHeader", ("h",), ("//",), _C, (_D,), name="C Header"),
    Language("Cpp", ("cc", "cpp", "cxx", "c++"), ("//",), _C, (_D,), (('R"(', ')"'),), name="C++"),
    Language("CppHeader", ("hh", "hpp", "hxx", "inl"), ("//",), _C, (_D,), name="C++ Header"),
    Language("CppModule", ("cppm", "ixx", "mpp"), ("//",), _C, (_D,), name="C++ Module"),
    Language("CSharp", ("cs", "csx"), ("//",), _C, (_D,), (('@"', '"'),), name="C#"),
    Language("Java", ("java",), ("//",), _C, (_D,)),
    Language("JavaScript", ("js", "mjs", "cjs"), ("//",), _C, (_D, _S, ("`", "`"))),
    Language("Jsx", ("jsx",), ("//",), _C, (_D, _S, ("`", "`")), name="JSX"),
    Language("TypeScript", ("ts", "mts", "cts"), ("//",), _C, (_D, _S, ("`", "`"))),
    Language("Tsx", ("tsx",), ("//",), _C, (_D, _S, ("`", "`")), name="TSX"),
    Language("Go", ("go",), ("//",), _C, (_D,), (("`", "`"),)),
    Language("Rust", ("rs",), ("//",), _C, (_D,), (('r##"', '"##'), ('r#"', '"#')), nested=True),
    Language("Swift", ("swift",), ("//",), _C, (_D,), nested=True),
    Language("Kotlin", ("kt", "kts"), ("//",), _C, (_D, ('"""', '"""')), nested=True),
    Language("Scala", ("scala", "sc"), ("//",), _C, (_D,), nested=True),
    Language("Gleam", ("gleam",), ("//",), (), (_D,)),
    Language("Php", ("php",), ("#", "//"), _C, (_D, _S), name="PHP"),
    Language("Python", ("py", "pyw", "pyi"), ("#",), (), (_D, _S), (), (('"""', '"""'), ("'''", "'''"))),
    Language("Ruby", ("rb", "rake"), ("#",), (("=begin", "=end"),), (_D, _S)),
    Language("Perl", ("pl", "pm"), ("#",), (("=pod", "=cut"),), (_D, _S)),
    Language("Sh", ("sh",), ("#",), (), (_D, _S), name="Shell"),
    Language("Bash", ("bash",), ("#",), (), (_D, _S), name="BASH"),
    Language("R", ("r", "R"), ("#",), (), (_D, _S)),
    Language("Julia", ("jl",), ("#",), (("#=", "=#"),), (_D, ('"""', '"""')), nested=True),
    Language("Elixir", ("ex", "exs"), ("#",), (), (_D, _S, ('"""', '"""'))),
    Language("Haskell", ("hs",), ("--",), (), (_D,), nested=True, nested_comments=(("{-", "-}"),)),
    Language("Lua", ("lua",), ("--",), (("--[[", "]]"),), (_D, _S)),
    Language("Sql", ("sql",), ("--",), _C, (_S,), name="SQL"),
    Language("Toml", ("toml",), ("#",), (), (_D, _S, ('"""', '"""'), ("'''", "'''")), name="TOML"),
    Language("Yaml", ("yaml", "yml"), ("#",), (), (_D, _S), name="YAML"),
    Language("Json", ("json",), (), (), (), name="JSON"),
    Language("Html", ("html", "htm"), (), (("<!--", "-->"),), (_D, _S), name="HTML"),
    Language("Xml", ("xml",), (), (("<!--", "-->"),), (_D, _S), name="XML"),
    Language("Css", ("css",), (), _C, (_D, _S), name="CSS"),
    Language("Markdown", ("md", "markdown"), literate=True),
    Language("Text", ("txt", "text"), name="Plain Text"),
]

_X = (("<!--", "-->"),)
_B = ("`", "`")
_P = (("(*", "*)"),)

# Languages that share their markers, as key:extension,extension in each group.
_GROUPS: list[tuple[dict, str]] = [
    (dict(line=("//",), block=_C, quotes=(_D,)), "ActionScript:as AIDL:aidl Alloy:als Apex:cls Arduino:ino AspectJ:aj Bicep:bicep Cuda:cu,cuh Cangjie:cj Ceylon:ceylon Chapel:chpl "
     "DeviceTree:dts,dtsi Fantom:fan GdShader:gdshader Glsl:vert,tesc,tese,geom,frag,comp,glsl Graphviz:gv,dot Hlsl:hlsl,fx,fxh Ispc:ispc,isph Jai:jai Idl:idl Lalrpop:lalrpop Metal:metal "
     "ObjectiveC:m ObjectiveCpp:mm OpenCl:ocl OpenScad:scad Pike:pike,pmod Processing:pde Protobuf:proto Qml:qml Reason:re,rei ReScript:res,resi Slint:slint Solidity:sol SystemVerilog:sv,svh "
     "UnrealScript:uc UnrealShader:usf,ush Vala:vala Verilog:v,vh Wgsl:wgsl Yacc:y,yy Lex:l,lex Xtend:xtend ZenCode:zs Jsonnet:jsonnet,libsonnet Bsv:bsv Cairo:cairo Move:move Haxe:hx Swig:i Smithy:smithy Squirrel:nut TypeSpec:tsp Tact:tact"),
    (dict(line=("//",), block=_C, quotes=(_D, _S)), "Astro:astro Dart:dart Groovy:groovy,grt,gtpl,gvy Gradle:gradle Less:less Sass:sass,scss Stylus:styl Json5:json5 Jsonc:jsonc Hjson:hjson Ballerina:bal MonkeyC:mc PostCss:pcss,sss Qcl:qcl ArkTs:ets Ring:ring Wren:wren "),
    (dict(line=("//",), block=_C, quotes=(_D,), nested=True), "Odin:odin Carbon:carbon Noir:nr Sway:sw Typst:typ Pkl:pkl"),
    (dict(line=("//",), quotes=(_D,)), "Zig:zig Zon:zon Cue:cue Ron:ron AvroIdl:avdl"),
    (dict(line=("//",), block=_C, quotes=(_D,), nested_comments=(("/+", "+/"),)), "D:d"),
    (dict(line=("#",), quotes=(_D, _S)), "Awk:awk Ninja:ninja LiveScript:ls Fish:fish Zsh:zsh Ksh:ksh CShell:csh Tcsh:tcsh CMake:cmake Crystal:cr NimScript:nims GdScript:gd Snakemake:smk,rules Starlark:bzl,star Bazel:bazel BitBake:bb,bbclass,bbappend Boo:boo "
     "Cython:pyx,pxd,pxi Mojo:mojo Makefile:mak,mk Just:just Nushell:nu Elvish:elv Dockerfile:dockerfile,dockerignore Gemspec:gemspec Gherkin:feature Gn:gn,gni Sls:sls Puppet:pp RpmSpecfile:spec Systemd:service,socket,timer,mount Desktop:desktop EditorConfig:editorconfig "
     "Raku:raku,rakumod,rakutest,pm6,p6 Kakoune:kak Conf:conf Properties:properties Dotenv:env Gnuplot:gp,gnuplot,plt Tcl:tcl Xonsh:xsh Robot:robot RenPy:rpy Po:po,pot Koto:koto Ebuild:ebuild,eclass Rbi:rbi Rbs:rbs "),
    (dict(line=("#",), block=_C, quotes=(_D,)), "Hcl:hcl,tf,tfvars Thrift:thrift Nix:nix "),
    (dict(line=("#",), quotes=(_D, ('\"""', '\"""'))), "GraphQl:gql,graphql Roc:roc Coconut:coco Capnp:capnp Janet:janet"),
    (dict(line=("#",), block=(("###", "###"),), quotes=(_D, _S)), "CoffeeScript:coffee,cjsx "),
    (dict(line=("#",), block=(("#[", "]#"),), quotes=(_D, ('\"""', '\"""')), nested=True), "Nim:nim"),
    (dict(line=("#",), block=(("<#", "#>"),), quotes=(_D, _S)), "PowerShell:ps1,psm1,psd1,ps1xml"),
    (dict(line=(";",), quotes=(_D,)), "Clojure:clj ClojureScript:cljs ClojureC:cljc Edn:edn EmacsLisp:el Fennel:fnl,fnlm Hy:hy Lfe:lfe Assembly:asm Nasm:nasm Ini:ini RegEdit:reg Llvm:ll Clips:clp Pddl:pddl Beancount:bean,beancount Ledger:ledger,journal Papyrus:psc Purebasic:pb,pbi Carp:carp "),
    (dict(line=(";",), block=(("#|", "|#"),), quotes=(_D,), nested=True), "Lisp:lisp,lsp,cl,asd Scheme:scm,ss Racket:rkt,scrbl WebAssemblyScript:wast"),
    (dict(line=(";;",), block=(("(;", ";)"),), quotes=(_D,), nested=True), "WebAssembly:wat"),
    (dict(line=(";",), block=_C, quotes=(_D, _S)), "AutoHotKey:ahk Nsis:nsi,nsh Iss:iss"),
    (dict(line=("//", "#"), block=_C, quotes=(_D,)), "GnuAssembly:s,S Nextflow:nf Stan:stan Io:io Zeek:zeek Hack:hack,hh_hack Fbs:fbs"),
    (dict(line=("--",), quotes=(_D,)), "Ada:ada,adb,ads,pad Vhdl:vhd,vhdl Asn1:asn1 Eiffel:e Cabal:cabal "),
    (dict(line=("--",), quotes=(_D,), nested=True, nested_comments=(("{-", "-}"),)), "Agda:agda Elm:elm Idris:idr,lidr PureScript:purs Dhall:dhall Curry:curry Unison:u Hsc:hsc Futhark:fut"),
    (dict(line=("--",), block=(("/-", "-/"),), quotes=(_D,), nested=True), "Lean:lean,hlean"),
    (dict(line=("--",), block=(("--[[", "]]"),), quotes=(_D, _S)), "Luau:luau MoonScript:moon Terra:t Teal:tl Pico8:p8"),
    (dict(line=("--",), block=_P, quotes=(_D,)), "AppleScript:applescript,scpt"),
    (dict(line=("--",), block=_C, quotes=(_S,)), "PlSql:pls,plsql,pks,pkb Hive:hql"),
    (dict(block=_P, quotes=(_D,), nested=True), "OCaml:ml,mli,mll,mly StandardMl:sml,sig,fun Mathematica:wl,wls,nb Isabelle:thy Oberon:obn,mod Modula2:def "),
    (dict(line=("//",), block=_P, quotes=(_D,), nested=True), "FSharp:fs,fsi,fsx,fsscript Ats:dats,sats,hats"),
    (dict(line=("//",), block=(("{", "}"), ("(*", "*)")), quotes=(_S,), nested=True), "Pascal:pas,lpr,dpr "),
    (dict(line=("%",), quotes=(_D,)), "Erlang:erl,hrl Escript:escript TeX:tex,sty,ltx,dtx BibTeX:bib PostScript:ps,eps "),
    (dict(line=("%",), block=_C, quotes=(_D, _S)), "Prolog:pro,prolog,p Logtalk:lgt,logtalk"),
    (dict(line=("%", "#"), block=(("%{", "%}"),), quotes=(_D, _S)), "LilyPond:ly,ily"),
    (dict(line=("!",), quotes=(_D, _S)), "FortranModern:f03,f08,f90,f95,fpp FortranLegacy:f,for,ftn,f77,pfo Factor:factor XResources:xdefaults Clarion:clw"),
    (dict(line=("*",), quotes=(_D, _S)), "Cobol:cob,cbl,ccp,cobol,cpy Gams:gms"),
    (dict(line=("'", "REM"), quotes=(_D,)), "VisualBasic:vb VbScript:vbs FreeBasic:bi Brightscript:brs VisualBasic6:frm"),
    (dict(line=("REM", "::")), "Batch:bat,btm,cmd"),
    (dict(line=('"',), quotes=(_S,)), "VimScript:vim,vimrc "),
    (dict(line=("*", '"'), quotes=(_S,)), "Abap:abap"),
    (dict(block=_X, quotes=(_D, _S)), "Svg:svg Xsl:xsl,xslt Xaml:xaml Axaml:axaml MsBuild:csproj,vbproj,fsproj,props,targets,vcxproj Wsdl:wsdl Xsd:xsd Rng:rng Plist:plist RubyHtml:rhtml,erb Aspx:aspx,ascx,asmx Razor:cshtml,razor ColdFusion:cfm "
     "Jsp:jsp,jspx Handlebars:handlebars,hbs Dtd:dtd QtUi:ui Glade:glade Gpx:gpx Kml:kml Fxml:fxml Zul:zul Xhtml:xhtml Wix:wxs,wxi,wxl Marko:marko Riot:riot "),
    (dict(line=("//",), block=(("<!--", "-->"), ("/*", "*/")), quotes=(_D, _S, _B)), "Vue:vue Svelte:svelte"),
    (dict(block=(("{#", "#}"),), quotes=(_D, _S)), "Jinja2:j2,jinja,jinja2 Twig:twig Tera:tera Nunjucks:njk"),
    (dict(block=(("<%--", "--%>"),), quotes=(_D, _S)), "EmbeddedElixir:eex,heex,leex,sface"),
    (dict(block=(("<%#", "%>"),), quotes=(_D, _S)), "Ejs:ejs"),
    (dict(line=("//", "//-"), quotes=(_D, _S)), "Pug:pug,jade"),
    (dict(line=("-#",), quotes=(_D, _S)), "Haml:haml"),
    (dict(line=("/",), quotes=(_D, _S)), "Slim:slim Q:q K:k"),
    (dict(line=("\\",), block=(("( ", ")"),), quotes=(_D,)), "Forth:4th,forth,frt,fth"),
    (dict(line=("NB.",), quotes=(_S,)), "J:ijs"),
    (dict(line=("\u235d",), quotes=(_S,)), "Apl:apl,aplf,apln"),
    (dict(block=(('"', '"'),), quotes=(_S,)), "Smalltalk:st"),
    (dict(line=("//",), block=_P, quotes=(_S, _D)), "IecStructuredText:iecst,scl"),
    (dict(block=_C, quotes=(_D, _S)), "Rexx:rexx,rex Sas:sas Pli:pli LinkerScript:ld,lds"),
    (dict(line=("//", "*"), block=_C, quotes=(_D,)), "Stata:do,ado"),
    (dict(line=("..",)), "ReStructuredText:rst"),
    (dict(line=("//",), block=(("////", "////"),)), "AsciiDoc:adoc,asciidoc"),
    (dict(literate=True), "Org:org Mdx:mdx RMarkdown:rmd,Rmd Quarto:qmd Djot:dj Textile:textile Creole:creole MediaWiki:mediawiki,wiki"),
    (dict(), "Jupyter:ipynb Csv:csv Tsv:tsv Diff:diff,patch JsonLines:jsonl,ndjson GeoJson:geojson WebManifest:webmanifest Brainfuck:bf Whitespace:ws Befunge:befunge "),
]
TABLE += [Language(key, tuple(ext.split(",")), **marks) for marks, rows in _GROUPS for key, ext in (row.split(":") for row in rows.split())]


@cache
def by_key() -> dict[str, Language]:
    return {x.key: x for x in TABLE}


@cache
def by_extension() -> dict[str, Language]:
    """Extension to language; the first in the table has an extension that several claim."""
    out: dict[str, Language] = {}
    for x in TABLE:
        for e in x.extensions:
            out.setdefault(e, x)
    return out


def resolve(hint: str) -> str | None:
    """Language key of a hint: the exact key, else an extension (with or without its dot)."""
    if hint in by_key():
        return hint
    found = by_extension().get(hint.removeprefix("."))
    return found.key if found else None


def languages(spark: SparkSession) -> DataFrame:
    rows = [(x.key, x.name or x.key, list(x.extensions), list(x.line), [tuple(p) for p in x.block], [tuple(p) for p in x.quotes], x.nested, x.literate, x.trivial) for x in TABLE]
    pair = "array<struct<start:string,end:string>>"
    return spark.createDataFrame(rows, f"lang string, name string, extensions array<string>, line_comment array<string>, block_comment {pair}, quotes {pair}, nested boolean, literate boolean, trivial boolean")


def extensions(spark: SparkSession) -> DataFrame:
    """ext, lang: one row an extension."""
    return spark.createDataFrame([(e, x.key) for e, x in by_extension().items()], "ext string, lang string")
