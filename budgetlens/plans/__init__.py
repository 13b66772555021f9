"""budgetlens.plans"""
