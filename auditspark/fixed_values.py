"""Vocabularies, patterns, weights and formats that results depend on.

Everything in this module is data that must have exactly these values for results to be
right. Patterns are written in the common subset of regular-expression dialects;
:func:`auditspark.functions.text.jre` adds the flags Spark needs.
"""

# --------------------------------------------------------------------------------------
# FIXED VALUES - ordered levels
# --------------------------------------------------------------------------------------
SEVERITIES = ["info", "low", "medium", "high", "critical"]
CONFIDENCES = ["low", "medium", "high"]
EXPOSURES = ["none-observed", "low", "moderate", "elevated", "not-assessable"]
DIFF_LEVELS = ["info", "low", "medium", "high"]
DRIFT_LEVELS = ["info", "medium", "high"]

# --------------------------------------------------------------------------------------
# FIXED VALUES - rules: id -> (title, category, default severity, gateable)
# --------------------------------------------------------------------------------------
RULES = {
    "SEC001": ("Possible hardcoded API credential", "secret", "critical", True),
    "SEC002": ("Possible hardcoded password", "secret", "high", True),
    "SEC003": ("Interpolated SQL statement", "injection", "high", False),
    "REL001": ("Swallowed exception", "reliability", "low", False),
    "NET001": ("Insecure non-local HTTP endpoint", "network", "low", False),
    "NET002": ("Request timeout not observed", "network", "medium", False),
    "CTRL001": ("Authentication control not observed", "control", "info", False),
    "CTRL002": ("Input validation control not observed", "control", "info", False),
    "CTRL003": ("Rate limiting control not observed", "control", "info", False),
    "AI001": ("Untrusted input observed flowing into prompt construction", "ai-prompt", "high", False),
    "AI002": ("Model output observed reaching a dangerous execution or injection sink", "ai-output", "critical", True),
    "AI003": ("Approval control not observed for high-impact tool capability", "ai-agency", "info", False),
    "AI004": ("Identifier suggesting sensitive data observed in an external model call", "ai-disclosure", "medium", False),
    "AI005": ("Model, endpoint, or artifact dependency observed without a pin or integrity control", "ai-supplychain", "medium", False),
    "AI006": ("Identifier suggesting sensitive data observed flowing to a network egress sink", "ai-disclosure", "high", False),
    "AI007": ("Deterministic sampling not observed on high-impact-adjacent call sites", "ai-stability", "info", False),
    "CTRL004": ("Observability construct not observed for agent tool execution", "control", "info", False),
    "CTRL005": ("Rate limiting not observed on a high-impact-capability loop", "control", "low", False),
    "CTRL006": ("Sandboxing not observed on an exec path", "control", "low", False),
    "CTRL007": ("No kill-switch signal observed on the agent's entry path", "control", "info", False),
    "DECL001": ("Declared autonomy contradicts inferred autonomy", "contradiction", "critical", True),
    "DECL002": ("Declared economic authority has no enforcement observed", "contradiction", "high", True),
    "DECL003": ("Money-moving or contract-signing permission with no declared economic authority", "contradiction", "high", True),
    "DECL004": ("Scanned data class not present in declared data classes", "contradiction", "high", True),
    "DECL005": ("Production agent has no observability observed", "contradiction", "medium", True),
    "DECL006": ("Scanned agent has no declaration entry", "contradiction", "medium", False),
    "DECL007": ("Declaration references an agent id no longer produced by the scanner", "contradiction", "low", False),
    "RT001": ("Declared human oversight not observed at runtime", "runtime", "critical", False),
    "RT002": ("Observed monetary action exceeds declared economic authority", "runtime", "high", False),
    "RT003": ("Observed capability absent from both registry and declarations", "runtime", "high", False),
    "RT004": ("Monitoring declared for a production agent, but no traces observed", "runtime", "medium", False),
    "RT005": ("Approval gate observed firing on all high-impact actions", "runtime", "info", False),
}
RULE_ID_SHAPE = r"^[A-Z]{2,5}\d{3}$"
TRUST_REMOTE_CODE_TITLE = "`trust_remote_code=True` observed on a model artifact load"

# FIXED VALUES - risk-list categories (two editions) per AI rule
RISK_LIST = {
    "AI001": ("LLM01", "LLM01"), "AI002": ("LLM02", "LLM05"), "AI003": ("LLM08", "LLM06"),
    "AI004": ("LLM06", "LLM02"), "AI005": ("LLM05", "LLM03"), "AI006": ("LLM06", "LLM02"),
    "AI007": ("LLM05", "LLM03"), "CTRL004": ("LLM10", "LLM10"),
}

# --------------------------------------------------------------------------------------
# FIXED VALUES - agent-construct patterns by framework, with display labels
# --------------------------------------------------------------------------------------
FRAMEWORK_PATTERNS = {
    "langchain": r"\b(?:AgentExecutor|initialize_agent|create(?:_|(?=[A-Z]))(?:react|tool_calling|toolCalling|openai_functions|openaiFunctions)(?:_agent|Agent))\s*\(",
    "langgraph": r"\b(?:create_react_agent|createReactAgent|StateGraph)\s*\(",
    "crewai": r"\bCrew\s*\(|\bAgent\s*\(\s*(?:role|goal|backstory)\s*=",
    "autogen": r"\b(?:AssistantAgent|ConversableAgent|UserProxyAgent|RoundRobinGroupChat|SelectorGroupChat)\s*\(",
    "llamaindex": r"\b(?:ReActAgent|FunctionAgent|AgentWorkflow|OpenAIAgent)\s*[.(]",
    "openai_agents_sdk": r"(?m)^\s*from\s+agents\s+import\b|\bRunner\.(?:run|run_sync|run_streamed)\s*\(",
    "pydantic_ai": r"\bfrom\s+pydantic_ai(?:\.\w+)*\s+import\b",
    "bedrock_agents": r"\b(?:invoke_agent|retrieve_and_generate)\s*\(",
    "semantic_kernel": r"\bimport\s+semantic_kernel\b|\bfrom\s+semantic_kernel\b|\bKernel\s*\(\s*\)",
    "vercel_ai_sdk": r"\bExperimental_Agent\b|\b(?:maxSteps|stopWhen)\s*:",
    "mastra": r"(?:from\s+|require\()['\"]@mastra/",
    "smolagents": r"(?m)\b(?:CodeAgent|ToolCallingAgent)\s*\(|^\s*from\s+smolagents\s+import\b",
    "dspy": r"\bdspy\.(?:ReAct|Agent)\b",
    "agno": r"(?m)^\s*from\s+agno(?:\.\w+)*\s+import\b|^\s*import\s+agno\b|\bagno\.agent\b",
    "google_adk": r"(?m)\bgoogle\.adk\b|^\s*from\s+google\.adk\b|(?:from\s+|require\()['\"]@iqai/adk['\"]",
    "strands": r"(?m)^\s*from\s+strands(?:_tools|_agents)?\s+import\b|^\s*import\s+strands\b",
    "mcp": r"(?m)\bFastMCP\s*\(|@(?:mcp|app|server)\.tool\b|@(?:mcp|server)\.(?:list_tools|call_tool|resource|prompt)\b|['\"]@modelcontextprotocol/sdk|\bMcpServer\s*\(|^\s*from\s+mcp\.server(?:\.\w+)*\s+import\b",
}
FRAMEWORK_LABELS = {
    "langchain": "LangChain", "langgraph": "LangGraph", "crewai": "CrewAI", "autogen": "AutoGen",
    "llamaindex": "LlamaIndex", "openai_agents_sdk": "OpenAI Agents SDK", "pydantic_ai": "PydanticAI",
    "bedrock_agents": "Amazon Bedrock Agents", "semantic_kernel": "Semantic Kernel",
    "vercel_ai_sdk": "Vercel AI SDK", "mastra": "Mastra", "smolagents": "smolagents", "dspy": "DSPy",
    "agno": "Agno", "google_adk": "Google ADK", "strands": "AWS Strands", "mcp": "MCP server",
}

# FIXED VALUES - weights and thresholds of the candidate score
SCORE_FRAMEWORK = 5
SCORE_LOOP = 4
SCORE_EXECUTION = 3
SCORE_MULTI_STEP = 2
SCORE_PROVIDER_CALL = 2
SCORE_TOOLS = 2
SCORE_PROVIDER_IMPORT = 1
SCORE_AGENT_CLASS = 1
SCORE_TESTLIKE = -3
SCORE_HIGH, SCORE_MEDIUM, SCORE_LOW = 8, 5, 3

# FIXED VALUES - supporting evidence and symbol patterns
MODEL_CALL_FOR_FLOW = r"\b(?:chat\.completions|responses|messages)\.create\s*\(|\b(?:generate_content|generateContent)\s*\(|\.(?:invoke|ainvoke|stream)\s*\(|\b(?:generateText|streamText|generateObject|streamObject)\s*\(|\blitellm\.(?:completion|acompletion)\s*\("
PROVIDER_CALL = r"\b(?:responses|chat\.completions|messages)\.create\s*\(|\b(?:generate_content|generateContent)\s*\(|\b(?:generateText|streamText|generateObject|streamObject)\s*\("
LITELLM_CALL = r"\blitellm\.(?:completion|acompletion)\s*\(|\bRouter\s*\("
TOOL_SCHEMA = r"\b(?:tools|tool_choice|functions)\s*[:=]\s*(?:\[|\{)"
AGENT_EXECUTION = r"\b(?:agent\.(?:run|invoke|ainvoke)|\w*agent\.(?:run|invoke|ainvoke)|crew\.kickoff|Runner\.(?:run|run_sync|run_streamed))\s*\("
AGENT_CLASS = r"\bclass\s+(\w*Agent\w*)\b"
GENERIC_AGENT_NAME = r"(?i)\b\w*(?:user|browser|http|monitoring|build|release|deploy|forwarding)agent\w*\b"
AGENT_CONSTRUCTOR_ASSIGNMENT = r"(?m)^\s*(?:const\s+|let\s+|var\s+|export\s+(?:const\s+|default\s+)?)?([A-Za-z_]\w*)\s*(?::\s*[\w.<>\[\] ]+)?=\s*(?:await\s+|new\s+)?(Agent|AgentExecutor|Crew|AssistantAgent|ConversableAgent|UserProxyAgent|ReActAgent|FunctionAgent|AgentWorkflow|OpenAIAgent|StateGraph|initialize_agent|create_react_agent|create_tool_calling_agent|create_openai_functions_agent)\s*[.(]"
AGENT_LIKE_VARIABLE = r"(?m)^\s*(?:const\s+|let\s+|var\s+)?([a-z_]\w*_agent|[a-z]\w*Agent)\s*="
AGENT_FACTORY_FUNCTION = r"\b(?:def|function)\s+((?:build|create|make|get)_?\w*[aA]gent\w*)\s*\("
TESTLIKE_PATH = r"(?:^|/)(?:test|tests|testing|__tests__|fixtures?|mocks?|examples?|sample|samples|snapshots)(?:/|$)|(?:^|/)test_[^/]*$|[^/]*_test\.\w+$|[^/]*\.(?:test|spec)\.\w+$"

# --------------------------------------------------------------------------------------
# FIXED VALUES - model providers
# --------------------------------------------------------------------------------------
PROVIDER_PATTERNS = {
    "openai": r"(?m)^\s*(?:import\s+openai\b|from\s+openai(?:\.\w+)*\s+import\b)|(?:from\s+|require\()['\"](?:openai|@ai-sdk/openai)['\"]|\b(?:OpenAI|AsyncOpenAI)\s*\(|\bcreateOpenAI\s*\(|api\.openai\.com|['\"]gpt-[45][\w.-]*['\"]|['\"]o[134][\w.-]*['\"]|\bOPENAI_API_KEY\b",
    "anthropic": r"(?m)^\s*(?:import\s+anthropic\b|from\s+anthropic(?:\.\w+)*\s+import\b)|(?:from\s+|require\()['\"](?:@anthropic-ai/sdk|@ai-sdk/anthropic)['\"]|\b(?:Anthropic|AsyncAnthropic)\s*\(|\bcreateAnthropic\s*\(|api\.anthropic\.com|['\"]claude-[\w.-]+['\"]|\bANTHROPIC_API_KEY\b",
    "google": r"google\.generativeai|google-genai|\bfrom\s+google\s+import\s+genai\b|['\"](?:@google/generative-ai|@ai-sdk/google)['\"]|\bcreateGoogleGenerativeAI\s*\(|\bvertexai\b|\bVertexAI\s*\(|generativelanguage\.googleapis\.com|['\"]gemini-[\w.-]+['\"]|\b(?:GOOGLE_API_KEY|GEMINI_API_KEY|GOOGLE_GENERATIVE_AI_API_KEY)\b",
    "azure_openai": r"\bAzureOpenAI\s*\(|\.openai\.azure\.com|\bAZURE_OPENAI[A-Z_]*\b|['\"]@ai-sdk/azure['\"]|\bcreateAzure\s*\(",
    "bedrock": r"bedrock-runtime|bedrock-agent-runtime|\bChatBedrock\b|\bBedrockChat\b|boto3\.client\(\s*['\"]bedrock|\binvoke_model\s*\(|['\"]@ai-sdk/amazon-bedrock['\"]|\bcreateAmazonBedrock\s*\(",
    "groq": r"(?m)^\s*from\s+groq\s+import\b|(?:from\s+|require\()['\"](?:groq-sdk|@ai-sdk/groq)['\"]|\bGroq\s*\(|\bcreateGroq\s*\(|api\.groq\.com|\bGROQ_API_KEY\b",
    "cohere": r"(?m)^\s*import\s+cohere\b|^\s*from\s+cohere\s+import\b|(?:from\s+|require\()['\"]@ai-sdk/cohere['\"]|\bcreateCohere\s*\(|cohere\.(?:Client|ClientV2)\s*\(|api\.cohere\.(?:ai|com)|\bCOHERE_API_KEY\b",
    "together": r"(?m)^\s*from\s+together\s+import\b|\bTogether\s*\(|api\.together\.(?:xyz|ai)|['\"]@ai-sdk/togetherai['\"]|\bcreateTogetherAI\s*\(|\bTOGETHER_API_KEY\b",
    "mistral": r"\bmistralai\b|api\.mistral\.ai|\bMISTRAL_API_KEY\b|['\"]@ai-sdk/mistral['\"]|\bcreateMistral\s*\(|['\"]mistral-(?:large|medium|small|tiny)[\w.-]*['\"]",
    "xai": r"['\"]@ai-sdk/xai['\"]|\bcreateXai\s*\(|api\.x\.ai|\bXAI_API_KEY\b|['\"]grok-[\w.-]+['\"]",
    "perplexity": r"api\.perplexity\.ai|\bPERPLEXITY_API_KEY\b|['\"]@ai-sdk/perplexity['\"]",
    "huggingface": r"\bhuggingface_hub\b|\bInferenceClient\s*\(|api-inference\.huggingface\.co|\b(?:HF_TOKEN|HUGGINGFACE(?:HUB)?_API_(?:KEY|TOKEN))\b",
    "ollama": r"(?m)^\s*import\s+ollama\b|\bollama\.(?:chat|generate)\s*\(|localhost:11434|\bChatOllama\b",
    "openrouter": r"openrouter\.ai|\bOPENROUTER_API_KEY\b",
    "litellm": r"(?m)^\s*import\s+litellm\b|^\s*from\s+litellm\s+import\b|\blitellm\.(?:completion|acompletion)\s*\(",
}
MODEL_PREFIX = r"['\"](openai|anthropic|gemini|vertex_ai|groq|bedrock|mistral|azure|together_ai|cohere|ollama|openrouter|perplexity|huggingface)/[\w.:-]+['\"]"
PREFIX_TO_PROVIDER = {
    "openai": "openai", "anthropic": "anthropic", "gemini": "google", "vertex_ai": "google",
    "groq": "groq", "bedrock": "bedrock", "mistral": "mistral", "azure": "azure_openai",
    "together_ai": "together", "cohere": "cohere", "ollama": "ollama", "openrouter": "openrouter",
    "perplexity": "perplexity", "huggingface": "huggingface",
}
DIRECT_MODEL_ENDPOINT = r"https?://(?:api\.openai\.com/v1/(?:responses|chat/completions)|api\.anthropic\.com/v1/messages|api\.groq\.com/openai/v1/chat/completions|openrouter\.ai/api/v1/chat/completions)"
ENDPOINT_HOST_TO_PROVIDER = {
    "openai.com": "openai", "anthropic.com": "anthropic", "groq.com": "groq", "openrouter.ai": "openrouter",
}

# --------------------------------------------------------------------------------------
# FIXED VALUES - capabilities
# --------------------------------------------------------------------------------------
CAPABILITY_PATTERNS = {
    "tool_calling": r"\btools\s*[:=]\s*(?:\[|\{)|\btool_choice\b|@tool\b|\bStructuredTool\b|\bbind_tools\s*\(|\bFunctionTool\b",
    "function_calling": r"\bfunctions\s*[:=]\s*\[|\bfunction_call\b|\bfunction_calling\b",
    "database_read": r"(?i)['\"`][^'\"`]*\bSELECT\b[^'\"`]*\bFROM\b|f['\"][^'\"]*\bSELECT\b",
    "database_write": r"(?i)\bINSERT\s+INTO\b|\bUPDATE\s+\w+\s+SET\b|\bDELETE\s+FROM\b|\bDROP\s+TABLE\b|\bALTER\s+TABLE\b|\bTRUNCATE\s+TABLE\b|\.(?:insert_one|insert_many|update_one|update_many|delete_one|delete_many)\s*\(",
    "code_execution": r"(?<![\w.])(?:eval|exec)\s*\(|\bnew\s+Function\s*\(|\bcompile\s*\([^)]*['\"]exec['\"]",
    "shell_execution": r"\bsubprocess\.(?:run|Popen|call|check_call|check_output)\s*\(|\bos\.(?:system|popen)\s*\(|\bchild_process\b|\b(?:execSync|spawnSync|execFile|spawn)\s*\(",
    "filesystem_read": r"\.read_text\s*\(|\.read_bytes\s*\(|\bfs\.readFile|\breadFileSync\s*\(|\bopen\s*\(\s*[^,)]+(?:,\s*['\"]rb?['\"])?\s*\)",
    "filesystem_write": r"\.write_text\s*\(|\.write_bytes\s*\(|\bfs\.writeFile|\bwriteFileSync\s*\(|\bopen\s*\([^)]*['\"][wa]b?['\"]|\bshutil\.(?:copy|move|rmtree)\b",
    "web_search": r"(?i)\btavily\b|\bserpapi\b|\bTavilyClient\b|\bDuckDuckGoSearch\w*\b|\bGoogleSerperAPI\w*\b|api\.bing\.microsoft\.com|serpapi\.com|\bbrave.?search\b",
    "browser_automation": r"(?i)\bplaywright\b|\bselenium\b|\bpuppeteer\b|\bwebdriver\b",
    "external_http": r"\brequests\.(?:get|post|put|patch|delete|request)\s*\(|\bhttpx\.(?:get|post|put|patch|delete|request|Client|AsyncClient)\b|\baiohttp\.ClientSession\b|\bfetch\s*\(|\baxios\b|\burllib\.request\.urlopen\s*\(",
    "email_send": r"(?i)\bsendgrid\b|\bsmtplib\b|\bSMTP\s*\(|\bnodemailer\b|\bsend_email\s*\(|\bsesv?2?\b.{0,40}send|boto3\.client\(\s*['\"]ses",
    "messaging": r"chat\.postMessage|chat_postMessage|hooks\.slack\.com|\bWebClient\s*\(|\btwilio\b.{0,60}messages|messages\.create\s*\(|discord(?:app)?\.com/api/webhooks",
    "payment_access": r"\bstripe\.(?:Charge|Refund|PaymentIntent|Payout|Transfer|SetupIntent)\b|\bstripe\.(?:charges|refunds|paymentIntents|payouts|transfers)\b|api\.stripe\.com",
    "customer_support": r"(?i)\bzendesk\b|\bintercom\b|\bfreshdesk\b|zdesk|\.zendesk\.com",
    "source_control": r"(?m)api\.github\.com|\bPyGithub\b|^\s*from\s+github\s+import\b|\boctokit\b|\bgitlab\b|api\.bitbucket\.org",
    "document_processing": r"(?i)\bpython-docx\b|\bimport\s+docx\b|\bopenpyxl\b|\bunstructured\b|\bmammoth\b",
    "pdf_processing": r"(?i)\bpypdf2?\b|\bpdfplumber\b|\bfitz\b|\bpymupdf\b|\bpdfminer\b",
    "cache_access": r"(?i)\bredis\b|\bmemcached?\b|\bRedis\s*\(|redis://",
    "queue_access": r"(?i)\bcelery\b|\bpika\b|\bkafka\b|\bamqp\b|boto3\.client\(\s*['\"]sqs|sqs\.[a-z0-9-]+\.amazonaws\.com",
    "cloud_resource_access": r"\bboto3\.(?:client|resource)\s*\(|\bgoogle\.cloud\b|\bazure\.(?:mgmt|storage|identity)\b|\b@aws-sdk/",
    "vector_search": r"(?i)pinecone|weaviate|chromadb|qdrant|pgvector|milvus|lancedb|\bfaiss\b|\bpc\.Index\s*\(|\b(?:similarity_search|max_marginal_relevance_search)\s*\(",
    "mcp_tools": r"(?m)\bFastMCP\s*\(|['\"]@modelcontextprotocol/sdk|^\s*from\s+mcp(?:\.\w+)*\s+import\b|\bmcp\.server\b|\b@mcp\.tool\b",
}
HIGH_IMPACT_CAPABILITIES = [
    "cloud_resource_access", "code_execution", "database_write", "email_send", "filesystem_write",
    "messaging", "payment_access", "shell_execution", "source_control",
]
PERMISSION_PATTERNS = {
    "move_funds": r"\bstripe\.(?:Transfer|Payout)\b|\bstripe\.(?:transfers|payouts)\b|(?i:\bpaypal\b.{0,40}\b(?:payout|transfer)\b)|(?i:\bplaid\b.{0,40}\btransfer\b)|(?i:\badyen\b.{0,40}\b(?:payout|transfer)\b)|(?i:\b(?:ach|wire)[_-]?transfer\w*\b)",
    "approve_transactions": r"\bstripe\.(?:PaymentIntent|Charge)\.(?:confirm|capture)\b|(?i:\bpaypal\b.{0,40}\bapprove\b)|(?i:\bplaid\b.{0,40}\bauthorize\b)|(?i:\badyen\b.{0,40}\b(?:capture|authoris|authoriz)\w*\b)",
    "sign_contracts": r"(?i)\bdocusign\b|\bdropbox[_-]?sign\b|\bhellosign\b|\badobe[_-]?sign\b",
    "delete": r"(?i)\bDROP\s+TABLE\b|\bDELETE\s+FROM\b|\.delete_one\s*\(|\.delete_many\s*\(|\.deleteOne\s*\(|\.deleteMany\s*\(|\bshutil\.rmtree\b|\bos\.(?:remove|unlink|rmdir)\s*\(|\bfs\.(?:unlink|rm\w*)\s*\(",
}
MONEY_TAGS = ["move_funds", "approve_transactions"]
MONEY_OR_CONTRACT_TAGS = ["move_funds", "approve_transactions", "sign_contracts"]

# --------------------------------------------------------------------------------------
# FIXED VALUES - integrations
# --------------------------------------------------------------------------------------
INTEGRATION_PATTERNS = {
    "slack": r"https?://(?:hooks\.slack\.com|slack\.com/api)/|\bslack_sdk\b|['\"]@slack/(?:web-api|bolt)['\"]|\bSLACK_[A-Z0-9_]*(?:URL|TOKEN|KEY)\b",
    "stripe": r"(?m)https?://api\.stripe\.com/v1/|^\s*import\s+stripe\b|(?:from\s+|require\()['\"]stripe['\"]|\bSTRIPE_[A-Z0-9_]*(?:KEY|SECRET|TOKEN)\b",
    "github": r"(?m)https?://api\.github\.com/|\bPyGithub\b|^\s*from\s+github\s+import\b|['\"](?:@octokit/rest|octokit)['\"]|\bGITHUB_[A-Z0-9_]*TOKEN\b",
    "gitlab": r"(?m)https?://gitlab\.com/api/|\bpython-gitlab\b|^\s*import\s+gitlab\b|\bGITLAB_[A-Z0-9_]*TOKEN\b",
    "zendesk": r"(?i)\.zendesk\.com|\bzenpy\b|\bZENDESK_[A-Z0-9_]+\b",
    "salesforce": r"https?://[^/\s'\"]+\.salesforce\.com/services/data/|\bsimple_salesforce\b|\bjsforce\b|\bSALESFORCE_[A-Z0-9_]+\b",
    "hubspot": r"https?://api\.hubapi\.com/|\bhubspot\b|\bHUBSPOT_[A-Z0-9_]+\b",
    "twilio": r"(?m)https?://api\.twilio\.com/|^\s*from\s+twilio\b|(?:require\()['\"]twilio['\"]|\bTWILIO_[A-Z0-9_]+\b",
    "sendgrid": r"https?://api\.sendgrid\.com/|\bsendgrid\b|\bSENDGRID_[A-Z0-9_]+\b",
    "ses": r"boto3\.client\(\s*['\"]sesv?2?['\"]|email\.[a-z0-9-]+\.amazonaws\.com",
    "datadog": r"(?i)\bdatadog\b|api\.datadoghq\.com|\bDD_API_KEY\b",
    "sentry": r"\bsentry_sdk\b|['\"]@sentry/|\bSENTRY_DSN\b|ingest\.sentry\.io",
    "postgres": r"(?m)postgres(?:ql)?://|\bpsycopg2?\b|^\s*import\s+asyncpg\b|(?:require\()['\"]pg['\"]|\bPOSTGRES[A-Z0-9_]*_(?:URL|URI|HOST|PASSWORD)\b|\bDATABASE_URL\b",
    "mysql": r"mysql://|\bpymysql\b|\bmysql\.connector\b|(?:require\()['\"]mysql2?['\"]",
    "mongodb": r"mongodb(?:\+srv)?://|\bpymongo\b|\bMongoClient\s*\(|\bmongoose\b",
    "redis": r"(?m)redis(?:s)?://|^\s*import\s+redis\b|\bRedis\s*\(|\bioredis\b",
    "snowflake": r"\bsnowflake\.connector\b|\bsnowflake-sdk\b|\bSNOWFLAKE_[A-Z0-9_]+\b",
    "bigquery": r"\bgoogle\.cloud\.bigquery\b|\bbigquery\.Client\s*\(|\b@google-cloud/bigquery\b",
    "aws": r"\bboto3\b|\b@aws-sdk/|\bAWS_(?:ACCESS_KEY_ID|SECRET_ACCESS_KEY|REGION)\b",
    "gcp": r"\bgoogle\.cloud\b|\bGOOGLE_APPLICATION_CREDENTIALS\b",
    "azure": r"\bazure\.(?:identity|storage|mgmt|keyvault)\b|\bAZURE_(?:CLIENT_ID|TENANT_ID|CLIENT_SECRET)\b",
    "jira": r"(?im)\.atlassian\.net/rest/api|^\s*from\s+jira\s+import\b|\bJIRA_[A-Z0-9_]+\b",
    "linear": r"api\.linear\.app|\b@linear/sdk\b|\bLINEAR_API_KEY\b",
    "notion": r"api\.notion\.com|\bnotion_client\b|\b@notionhq/client\b|\bNOTION_[A-Z0-9_]+\b",
    "confluence": r"(?i)/wiki/rest/api|\batlassian-python-api\b|\bCONFLUENCE_[A-Z0-9_]+\b",
    "servicenow": r"(?i)\.service-now\.com|\bpysnow\b|\bSERVICENOW_[A-Z0-9_]+\b",
    "shopify": r"(?i)myshopify\.com|\bshopify(?:_python)?_api\b|\bSHOPIFY_[A-Z0-9_]+\b",
    "pinecone": r"(?i)\bpinecone\b|api\.pinecone\.io|\bPINECONE_[A-Z0-9_]+\b|\bpc\.Index\s*\(",
    "weaviate": r"(?i)\bweaviate\b|\bWEAVIATE_[A-Z0-9_]+\b",
    "chroma": r"(?i)\bchromadb\b|\bchroma_client\b|\bPersistentClient\s*\(",
    "qdrant": r"(?i)qdrant",
    "milvus": r"(?i)\bmilvus\b|\bpymilvus\b|\bMILVUS_[A-Z0-9_]+\b",
    "google_places": r"(?i)maps\.googleapis\.com/maps/api/place|\bGOOGLE_PLACES_API_KEY\b",
    "eventbrite": r"(?i)eventbriteapi\.com|\bEVENTBRITE_[A-Z0-9_]+\b",
}
SENSITIVE_INTEGRATIONS = [
    "stripe", "salesforce", "zendesk", "hubspot", "twilio", "sendgrid", "ses", "postgres", "mysql",
    "mongodb", "snowflake", "bigquery", "aws", "gcp", "azure", "github", "gitlab", "shopify", "servicenow",
]

# --------------------------------------------------------------------------------------
# FIXED VALUES - line rules
# --------------------------------------------------------------------------------------
SECRET = r"(?<![A-Za-z0-9])(?:sk-(?:proj-)?[A-Za-z0-9_-]{20,}|sk-ant-[A-Za-z0-9_-]{20,}|gsk_[A-Za-z0-9]{20,}|sk_live_[A-Za-z0-9]{16,}|rk_live_[A-Za-z0-9]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9-]{20,}|AKIA[0-9A-Z]{16})(?![A-Za-z0-9])"
PLACEHOLDER = r"(?i)fake|dummy|example|redacted|changeme|placeholder|sample|your[-_]?(?:api[-_]?)?key|not[-_]?a[-_]?real|x{5,}|(?:\.\.\.|…)"
PASSWORD_ASSIGNMENT = r"(?i)\b(password|passwd|pwd|db_password|database_password|admin_password)\b\s*[:=]\s*(?:f?[\"']([^\"'\n]{4,})[\"'])"
PASSWORD_SAFE = r"(?i)os\.environ|getenv|process\.env|secretsmanager|secret_manager|get_secret|vault|keyring|input\(|getpass"
PASSWORD_WORDS = ["password", "secret", "none", "null"]
PASSWORD_TEMPLATE_STARTS = ["$", "{", "%", "<"]
PASSWORD_TEMPLATE_PARTS = ["${", "{}"]
_SQL = r"(?:SELECT\s+[\w*,.\s()]+\s+FROM|INSERT\s+INTO|UPDATE\s+\w+\s+SET|DELETE\s+FROM|DROP\s+TABLE)"
SQL_INTERPOLATION = [
    r"(?i)\bf['\"]{1,3}[^'\"\n]*" + _SQL + r"[^'\"\n]*\{",
    r"(?i)`[^`\n]*" + _SQL + r"[^`\n]*\$\{",
    r"(?i)['\"][^'\"\n]*" + _SQL + r"[^'\"\n]*['\"]\s*%\s*[\w(]",
    r"(?i)['\"][^'\"\n]*" + _SQL + r"[^'\"\n]*['\"]\s*\.\s*format\s*\(",
    r"(?i)(?:\"[^\"\n]*" + _SQL + r"[^\"\n]*\"|'[^'\n]*" + _SQL + r"[^'\n]*')\s*\+\s*[A-Za-z_]",
]
SWALLOWED_PY = r"(?m)^([ \t]*)except\b[^\n:]*:\s*(?:#[^\n]*)?\n\1[ \t]+pass\b"
SWALLOWED_JS = r"\bcatch\s*(?:\([^)]*\))?\s*\{\s*\}"
HTTP_URL = r"http://([^\s'\"`<>)\]}]+)"
LOCAL_HOST = r"(?i)^(?:localhost|127\.0\.0\.1|0\.0\.0\.0|\[?::1\]?|[\w.-]*\.(?:test|local|localhost|invalid|example)|example\.(?:com|org|net)|www\.w3\.org|schemas\.[\w.-]+|json-schema\.org)(?:[:/]|$)"
OUTGOING_CALL = r"\b(?:requests|httpx)\.(?:get|post|put|patch|delete|head|request)\s*\(|\burllib\.request\.urlopen\s*\("
TIMEOUT_ARG = r"\btimeout\s*="
TIMEOUT_LINES_AFTER = 8
COMMENT_LINE = r"^\s*(?:#|//|\*|/\*)"
MIN_SECRET_ENTROPY = 3.0
MIN_PASSWORD_ENTROPY = 2.0
SNIPPET_MAX = 200
# a redacted token keeps this many characters, then the mark and this much of its hash
REDACT_PREFIX, REDACT_HASH = 6, 12

# --------------------------------------------------------------------------------------
# FIXED VALUES - controls
# --------------------------------------------------------------------------------------
KILL_SWITCH = r"os\.(?:environ|getenv)\([^)]*(?:ENABLE|DISABLE|KILL_SWITCH|FEATURE_FLAG)|process\.env\.\w*(?:ENABLE|DISABLE|KILL_SWITCH|FEATURE_FLAG)|(?i:\blaunchdarkly\b|\bunleash\b|\bflagsmith\b|\bfeature[_-]?flag\w*\b)"
CONTROL_PATTERNS = {
    "CTRL001": r"(?i)\bauthenticat\w+\b|\bauthoriz\w+\b|\bauth[_-]?token\b|@login_required|\bverify_jwt\b|\bcheck_auth\b|\brequire[_-]?auth\b|\bBearer\b|\bapi[_-]?key[_-]?(?:check|verify|required)\b|\bfirebase[_-]?admin\b|\bverify_?id_?token\b|\bgetAuth\b|\bcurrentUser\b|\bcurrent_user\b|\breq\.user\b|\bctx\.user\b|@requires?_auth\b|\b(?:jwt|jose|pyjwt)\b|@jwt_required|\bensureAuthenticated\b|\bclerk\b|\bauth0\b|\bnext-?auth\b|\bpassport\b|\bsupabase\.auth\b|\bsession\[|\bget_current_user\b|\bHTTPBearer\b|\bOAuth2\w*\b",
    "CTRL002": r"(?i)\bvalidat\w+\b|\bpydantic\b|\bmarshmallow\b|\bcerberus\b|\bzod\b|\bjoi\b|\bBaseModel\b|\bsanitiz\w+\b|\bschema\s*\.\s*parse\b|\byup\b|\bajv\b|\bclass-validator\b|\bvalidator\b|\.parse\s*\(|\bis_?valid\b|\bValidationError\b|\bEmailStr\b|\bconstr\s*\(",
    "CTRL003": r"(?i)\brate[_-]?limit\w*\b|\bthrottl\w+\b|\bLimiter\b|\bslowapi\b|\bbottleneck\b|\btoken[_-]?bucket\b|\bflask[_-]?limiter\b|\bexpress-rate-limit\b|\brate-?limiter-?flexible\b|@ratelimit\b|\bupstash[/_]ratelimit\b|\bRateLimiter\b",
    "CTRL007": KILL_SWITCH,
}
CONTROL_NAMES = {"CTRL001": "authentication", "CTRL002": "validation", "CTRL003": "rate_limit", "CTRL007": "kill_switch"}
OBSERVABILITY = r"\b(?:logging|logger|log)\.(?:info|warning|warn|error|debug|exception|critical)\s*\(|\bstructlog\b|\bloguru\b|@observe\b|\blangsmith\b|\blangfuse\b|\bopentelemetry\b|\btraceloop\b|\bwandb\b|\btracer\.start_?[sS]pan\b|\b(?:winston|pino|bunyan)\b|\bconsole\.(?:error|warn)\s*\(|\bloki\b|\bgrafana\b|\bdatadog\b|\bddtrace\b|\bsentry(?:_sdk)?\b|\bnew_?relic\b|\belastic(?:apm|search)\b|\bfluentd?\b|\bstatsd\b|\bprometheus\b|\botel\b|\bhoneycomb\b|\bpino\b|\bslog\b|\bzap\.\w+\b"
AD_HOC_OUTPUT = r"\bprint\s*\(|\bconsole\.log\s*\("
APPROVAL = r"(?i)\binterrupt(?:_before|_after)?\s*[(=]|\bCommand\s*\(\s*resume|\brequires_approval\s*=\s*True\b|\bhuman_in_the_loop\b|\bneedsApproval\s*:\s*true\b|\bHumanApprovalCallbackHandler\b|\bhuman_input\b|\b(?:approv|confirm|authoriz|consent|reviewed?)\w*\b"
TOOL_BINDING = r"@(?:tool|function_tool)\b|\btools\s*[:=]\s*[\[{]|\bStructuredTool\.from_function\b|\bserver\.tool\s*\(|\btool\s*\(\s*\{|\bFunctionTool\b|\btool_choice\b"
BOUNDING = r"if\s+[\w.\[\]]+\s*[<>]=?\s*(?:MAX_\w+|\d+(?:\.\d+)?)\b|\bmin\s*\(\s*[\w.]+\s*,\s*(?:MAX_\w+|\d+(?:\.\d+)?)\s*\)"
BACKOFF = r"(?i:\btime\.sleep\s*\(|\bawait\s+asyncio\.sleep\s*\(|\bsetTimeout\s*\(|\bbackoff\b|\btenacity\b)"
SANDBOX = r"(?i:\bsubprocess\.\w+\([^)]*\benv\s*=|\bdocker\b|\bnsjail\b|\bfirejail\b|\bRestrictedPython\b|\bfirecracker\b|\bgvisor\b|\bWorkerSandbox\b|\bisolated-vm\b)|\bvm\.(?:createContext|runInNewContext)\b"

# --------------------------------------------------------------------------------------
# FIXED VALUES - model supply chain
# --------------------------------------------------------------------------------------
TRUST_REMOTE_CODE = r"\b(?:from_pretrained|pipeline)\s*\([^)]*\btrust_remote_code\s*=\s*True"
FROM_PRETRAINED = r"\bfrom_pretrained\s*\(\s*(['\"])([^'\"]+)\1([^)]*)\)"
REVISION_KW = r"\brevision\s*="
LOCAL_ARTIFACT = r"^[./]|\.(?:bin|pt|safetensors)$"
DOWNLOAD_HINTS = ["hf_hub_download", "snapshot_download", "urlretrieve", "requests.get", "wget", "urlopen"]
UNSAFE_LOAD = r"\b(?:torch\.load|pickle\.load|marshal\.load)\s*\("
MODEL_ASSIGN = r"\bmodel\s*[:=]\s*(['\"])([A-Za-z0-9][\w.:\-/]*)\1|\b(?:ChatOpenAI|ChatAnthropic|ChatGroq|OpenAI|Anthropic)\s*\([^)]*\bmodel\s*=\s*(['\"])([A-Za-z0-9][\w.:\-/]*)\3|\b(?:openai|anthropic|groq|google|createGroq|createOpenAI|createAnthropic)\s*\(\s*(['\"])([A-Za-z0-9][\w.:\-/]*)\5"
DATED_SNAPSHOT = r"-(?:\d{4}-\d{2}-\d{2}|\d{8})(?:$|['\"])|@[0-9a-f]{7,40}"
BASE_URL = r"\b(?:base_url|baseURL|api_base)\s*[:=]\s*(.+?)(?:[,)\n]|$)"
BASE_URL_HTTP = r"^\s*['\"]http://([^'\"/]+)"
BASE_URL_DYNAMIC = r"(?:os\.(?:environ|getenv)|process\.env|config\.)"
FLOATING_SUFFIX = "-latest"
FLOATING_ALIASES = [
    "gpt-4o", "gpt-4o-mini", "gpt-4.1", "gpt-4.1-mini", "gpt-4-turbo", "gpt-4", "gpt-3.5-turbo",
    "o1", "o1-mini", "o3", "o3-mini", "o4-mini",
    "claude-3-5-sonnet", "claude-3-5-haiku", "claude-3-opus",
    "claude-sonnet-4-5", "claude-sonnet-4-6", "claude-opus-4-1", "claude-haiku-4-5",
    "gemini-1.5-pro", "gemini-1.5-flash", "gemini-2.0-flash", "gemini-2.5-pro", "gemini-2.5-flash",
    "mistral-large", "mistral-small", "llama-3.3-70b", "llama-3.1-70b",
]
MODEL_CALL_SITE = r"\b(?:chat\.completions|responses|messages)\.create\s*\(|\b(?:generate_content|generateContent)\s*\(|\.(?:invoke|ainvoke|stream)\s*\(|\b(?:generateText|streamText|generateObject|streamObject)\s*\("
EMBEDDING_OR_MODERATION = r"\b(?:embeddings|moderations|embed|embedMany)\b"
CALL_CONTEXT_CHARS = 40
DETERMINISTIC_TEMPERATURE = r"\btemperature\s*[:=]\s*0(?:\.[0-3]\d*)?\b"

# --------------------------------------------------------------------------------------
# FIXED VALUES - flow sources and sinks
# --------------------------------------------------------------------------------------
MODEL_OUTPUT = r"\.choices\[\d+\]\.(?:message|delta)\.content\b|\.output_text\b|\.content\[\d+\]\.text\b|\bmessage\.content\b|\.completion\b|\b(?:llm|chain|agent)\.(?:invoke|ainvoke|run|call)\s*\(|\b(?:generateText|streamText)\s*\("
MODEL_CALL = r"\.(?:chat\.completions|responses|messages)\.create\s*\(|\.(?:generate_content|generateContent)\s*\(|\b(?:llm|chain|agent|model)\.(?:invoke|ainvoke|stream|run)\s*\(|\b(?:generateText|streamText|generateObject|streamObject)\s*\("
REQUEST_SOURCE = r"\brequest\.(?:args|form|get_json|json|data|values|files)\b|\breq\.(?:body|query|params)\b|\bformData\.get\s*\(|\binput\s*\(\s*\)|\bsys\.stdin\b|\.read\s*\(\s*\)|\b(?:retriever\.invoke|get_relevant_documents|index\.query)\s*\(|\.(?:similarity_search|similaritySearch)\s*\("
SECRET_SOURCE = r"os\.environ\[['\"][A-Z0-9_]*(?:KEY|SECRET|TOKEN|PASSWORD|DSN)['\"]\]|os\.getenv\(\s*['\"][A-Z0-9_]*(?:KEY|SECRET|TOKEN|PASSWORD|DSN)|process\.env\.[A-Z0-9_]*(?:KEY|SECRET|TOKEN|PASSWORD|DSN)|\.(?:api_key|secret|token|password|private_key)\b"
PII_TERMS = ["email", "phone", "ssn", "social_security", "dob", "date_of_birth", "address", "salary", "diagnosis", "patient", "passport", "iban", "card_number", "national_id"]
EGRESS = r"\brequests\.(?:post|put|patch)\s*\(|\bhttpx\.(?:post|put|patch)\b|\burllib\.request\.urlopen\s*\(|\bsmtplib\b|\.sendmail\s*\(|\.sendMail\s*\(|\bfetch\s*\(|\baxios\.(?:post|put|patch)\s*\(|\bput_object\s*\("
PROVIDER_HOST = r"api\.openai\.com|api\.anthropic\.com|api\.groq\.com|openrouter\.ai|generativelanguage\.googleapis\.com|api\.mistral\.ai|api\.cohere|api\.together|api\.perplexity\.ai|\.openai\.azure\.com"
LOCAL_ENDPOINT = r"localhost|127\.0\.0\.1|0\.0\.0\.0|://10\.|://192\.168\.|://172\.(?:1[6-9]|2\d|3[01])\."
BOUNDARY_WORD = r"(?i)sanitize|escape|redact|moderat|guard"
SINK_PATTERNS = {
    "exec": r"(?<![\w.])(?:eval|exec)\s*\(|\bos\.system\s*\(|\bsubprocess\.(?:run|Popen|call|check_output|check_call)\s*\(|\bpty\.spawn\s*\(|\bnew\s+Function\s*\(|\bchild_process\.(?:exec|execSync|spawn)\b|\bvm\.runInContext\b",
    "deserialize": r"\bpickle\.loads?\s*\(|\byaml\.load\s*\(|\bmarshal\.loads?\s*\(",
    "sql": r"\bcursor\.execute\s*\(|\.raw\s*\(|\btext\s*\(|\.query\s*\(",
    "markup": r"\bdocument\.write\s*\(|\bMarkup\s*\(|\bmark_safe\s*\(|\bdangerouslySetInnerHTML\b",
    "request": r"\brequests\.(?:get|post)\s*\(|\bfetch\s*\(|\bhttpx\.(?:get|post)\b",
}
MARKUP_TARGET = ".innerHTML"
SINK_SEVERITY = {"exec": "critical", "sql": "critical", "deserialize": "critical", "markup": "high", "request": "high"}
SIDE_EFFECT_SINKS = ["exec", "sql", "deserialize", "request"]
MAX_PROPAGATION = 5
PROPAGATION_ROUNDS = 6
CALL_ROUNDS = 3
TRANSPARENT_CALLS = ["json.loads", "JSON.parse", "json.load"]
CARRYING_METHODS = [".format", ".join", ".replace", ".map"]

# --------------------------------------------------------------------------------------
# FIXED VALUES - corpus listing
# --------------------------------------------------------------------------------------
LANGUAGE_BY_EXTENSION = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript",
}
DEFAULT_IGNORE = [
    ".git/**", ".venv/**", "venv/**", "env/**", "node_modules/**", "dist/**", "build/**", ".next/**",
    "coverage/**", "vendor/**", "third_party/**", "generated/**", "__pycache__/**", ".pytest_cache/**",
    ".mypy_cache/**", ".ruff_cache/**", "*.min.js", "*.bundle.js",
]
MAX_FILE_BYTES = 1_000_000
BOT_AUTHOR = r"(?i)(dependabot|renovate|github-actions|\[bot\])"
COMMITS_CONSIDERED = 5

# --------------------------------------------------------------------------------------
# FIXED VALUES - spans, declarations, runtime thresholds
# --------------------------------------------------------------------------------------
SPAN_KINDS = ["agent_run", "llm_call", "tool_call", "action", "approval", "retrieval", "delegation"]
SPAN_STATUSES = ["ok", "error"]
TRACE_MAJOR = "1"
AUTONOMY_INTENTS = ["recommend_only", "human_approved", "bounded_autonomous", "unrestricted_autonomous"]
OVERSIGHT_INTENTS = ["recommend_only", "human_approved"]
USERS_VALUES = ["internal", "customers", "public"]
PRODUCTION_STATUSES = ["dev", "staging", "production", "deprecated"]
DEPENDENCY_LEVELS = ["low", "medium", "high", "critical"]
DATA_CLASSES = ["personal", "financial", "health", "confidential", "ip", "authentication"]
SOCIETAL_RISK_FLAGS = ["critical_infrastructure", "biosecurity_adjacent", "mass_influence"]
APPROVAL_KINDS = ["capability", "integration", "provider", "new-agent"]
RATIO_THRESHOLD = 3.0
MIN_COUNT = 20
APPROVAL_DROP = 0.10
ERROR_RATE_ELEVATED = 0.10
ERROR_RATE_MODERATE = 0.02
RENAME_THRESHOLD = 0.70
UPGRADEABLE_DIMENSIONS = ["conduct-variability", "dependency-drift"]

# --------------------------------------------------------------------------------------
# FIXED VALUES - exposure ranking
# --------------------------------------------------------------------------------------
EXPOSURE_SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 1, "low": 0, "info": 0}
EXPOSURE_TIERS = [(14, "severe"), (7, "elevated"), (3, "moderate"), (0, "low")]

# --------------------------------------------------------------------------------------
# FIXED VALUES - default scoring taxonomy (id, tier, group) and its maps
# --------------------------------------------------------------------------------------
TAXONOMY_VERSION = "2.0"
DIMENSIONS = [
    ("mandate-overreach", "strong", "B"),
    ("boundary-leakage", "strong", "A"),
    ("unreviewed-high-impact-action", "strong", "C"),
    ("output-fidelity", "partial", "D"),
    ("injection-tamper-surface", "partial", "B"),
    ("conduct-variability", "proxy", "D"),
    ("dependency-drift", "proxy", "D"),
    ("control-coverage-gap", "partial", "B"),
]
FINDING_WEIGHTS = {"critical": 40, "high": 25, "medium": 12, "low": 5, "info": 2}
CONFIDENCE_MULTIPLIERS = {"high": 1.0, "medium": 0.6, "low": 0.3}
CAPABILITY_WEIGHT, PROVIDER_WEIGHT, CONTROL_CREDIT = 18, 8, 20
RULE_DIMENSIONS = {
    "SEC001": ["boundary-leakage", "control-coverage-gap"],
    "SEC002": ["boundary-leakage", "control-coverage-gap"],
    "SEC003": ["output-fidelity"],
    "REL001": ["control-coverage-gap"],
    "NET001": ["boundary-leakage", "dependency-drift"],
    "NET002": ["control-coverage-gap"],
    "CTRL001": ["unreviewed-high-impact-action", "control-coverage-gap"],
    "CTRL002": ["output-fidelity", "injection-tamper-surface", "control-coverage-gap"],
    "CTRL003": ["control-coverage-gap"],
    "CTRL004": ["control-coverage-gap"],
    "AI001": ["injection-tamper-surface"],
    "AI002": ["output-fidelity"],
    "AI003": ["mandate-overreach", "unreviewed-high-impact-action"],
    "AI004": ["boundary-leakage"],
    "AI006": ["boundary-leakage"],
    "AI007": ["conduct-variability"],
    "AI005": ["injection-tamper-surface", "dependency-drift"],
    "CTRL005": ["control-coverage-gap"],
    "CTRL006": ["control-coverage-gap", "mandate-overreach"],
    "CTRL007": ["control-coverage-gap"],
    "DECL001": ["unreviewed-high-impact-action", "mandate-overreach"],
    "DECL002": ["unreviewed-high-impact-action"],
    "DECL003": ["unreviewed-high-impact-action"],
    "DECL004": ["boundary-leakage"],
    "DECL005": ["control-coverage-gap"],
    "DECL006": ["control-coverage-gap"],
    "DECL007": ["control-coverage-gap"],
}
VARIANT_DIMENSIONS = {
    ("AI005", "floating-alias"): ["conduct-variability", "dependency-drift"],
    ("AI005", "trust-remote-code"): ["injection-tamper-surface"],
    ("AI005", "unpinned-artifact"): ["injection-tamper-surface"],
    ("AI005", "insecure-endpoint"): ["dependency-drift"],
}
_REACH = ["mandate-overreach", "unreviewed-high-impact-action"]
CAPABILITY_DIMENSIONS = {
    "payment_access": _REACH, "database_write": _REACH, "email_send": _REACH, "messaging": _REACH,
    "shell_execution": _REACH, "code_execution": _REACH, "filesystem_write": _REACH,
    "source_control": _REACH, "cloud_resource_access": _REACH,
    "external_http": ["boundary-leakage"],
    "vector_search": ["injection-tamper-surface"], "web_search": ["injection-tamper-surface"],
    "browser_automation": ["injection-tamper-surface"], "filesystem_read": ["injection-tamper-surface"],
    "mcp_tools": _REACH,
}
CONTROL_DIMENSIONS = {
    "approval": ["mandate-overreach", "unreviewed-high-impact-action"],
    "authentication": ["unreviewed-high-impact-action", "control-coverage-gap"],
    "validation": ["output-fidelity", "control-coverage-gap"],
    "rate_limit": ["control-coverage-gap"],
    "observability": ["control-coverage-gap"],
    "deterministic_sampling": ["conduct-variability"],
    "pinned_model": ["dependency-drift"],
}
BUCKET_LOW, BUCKET_MODERATE = 25, 55

# --------------------------------------------------------------------------------------
# FIXED VALUES - graph
# --------------------------------------------------------------------------------------
EDGE_KIND = {
    "database_read": "reads", "filesystem_read": "reads", "vector_search": "reads",
    "document_processing": "reads", "pdf_processing": "reads", "cache_access": "reads", "queue_access": "reads",
    "database_write": "writes", "filesystem_write": "writes", "code_execution": "writes",
    "shell_execution": "writes", "cloud_resource_access": "writes", "source_control": "writes",
    "payment_access": "writes", "customer_support": "writes",
    "web_search": "network", "browser_automation": "network", "external_http": "network",
    "email_send": "network", "messaging": "network",
    "mcp_tools": "mcp",
}
CAPABILITY_LABELS = {
    "mcp_tools": "MCP tools", "external_http": "External HTTP", "pdf_processing": "PDF processing",
    "cache_access": "Cache", "queue_access": "Message queue",
}
PROVIDER_EDGE_RULES = ["AI001", "AI004", "AI005", "AI007", "SEC001", "SEC002"]
TOOL_EDGE_RULES = ["SEC001", "SEC002"]
NETWORK_EDGE_RULES = ["NET001", "NET002", "AI006"]
DATABASE_EDGE_RULES = ["SEC003"]
EXEC_EDGE_RULES = ["AI002"]
HIGH_IMPACT_EDGE_RULES = ["AI003"]

# --------------------------------------------------------------------------------------
# FIXED VALUES - report formats
# --------------------------------------------------------------------------------------
SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
CONTROL_FIELDS = {
    "CTRL001": "authentication", "CTRL002": "input_validation", "CTRL003": "rate_limits",
    "CTRL004": "observability", "CTRL005": "loop_rate_limiting", "CTRL006": "sandboxing", "CTRL007": "kill_switch",
}
RELIABILITY_DIMENSIONS = ["output-fidelity", "conduct-variability", "dependency-drift"]
INVENTORY_FIELDS = ["owner", "purpose", "users", "geography", "production_status"]
